"""Region queries give all rows: brute force over a few rows."""

from collections import Counter

from helixgrid.plans import catalog


def test_all_junctions_in_order(spark, tmp_path):
    rows = [(o, 2, o % 90 + 1, 1, 20.0, "N") for o in range(1, 400)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = Counter()
    for o, line, part, supp, _, _ in rows:
        if (o + line) % 29 and (o * 3 + line) % 31 and (o * 11 + line) % 41:
            want["chr2", (part * 37 + line * 11) % 5000 + 10] += 1
    assert len(want) < 100
    rows = [(*r[:3], s, *r[4:]) for r in rows for s in (1, 2)]
    want |= Counter({("chr3", at): n for (_, at), n in want.items()})
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalog.queries()["t3_sorted_junctions"](spark, str(tmp_path)).collect()]
    assert len(want) > 100 and got == [(c, at, at + 100, n) for (c, at), n in sorted(want.items())]
