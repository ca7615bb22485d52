"""Read queries see whole texts: brute force over a few rows."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from helixgrid.operators import fastq as Q
from helixgrid.plans import catalog

FROM = "BDEFHIJKLMOPQRSUVWXYZbdefhijklmopqrsuvwxyzacgtn .,"
TO = "ACGTACGTACGTACGTACGTAACGTACGTACGTACGTACGTAACGTNNNN"
TEXTS = [(1, "Ab c" * 100), (2, None), (3, "é" + "x" * 900), (4, ""), (5, "Ab c" * 100), (6, "the end. " * 60)]


def seq(text):
    return (text or "").translate(str.maketrans(FROM, TO[: len(FROM)]))


def kmers(s, k):
    return [s[i : i + k].upper() for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGTacgt")]


def run(spark, folder, name):
    return [tuple(r) for r in catalog.queries()[name](spark, str(folder)).collect()]


def test_reads_are_whole(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "Ab c" * 60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    reads = {i: seq(t) for i, t in TEXTS}
    assert dict(run(spark, tmp_path, "a2_length_histogram")) == Counter(len(s) for s in reads.values())
    assert {r[0]: r[1] for r in run(spark, tmp_path, "a3_per_position")} == Counter(i for s in reads.values() for i in range(len(s)))
    assert {r[:2]: r[2] for r in run(spark, tmp_path, "p11_kmers")} == Counter((i, k) for i, s in reads.items() for k in kmers(s, 8))
    one = set(kmers(seq("Ab c" * 60), 8))
    known = one | {k[::-1].translate(str.maketrans("ACGT", "TGCA")) for k in one}
    assert {r[0] for r in run(spark, tmp_path, "s13_reference_kmers")} == known
    hits = {i: sum(k in known for k in kmers(s, 8)) for i, s in reads.items()}
    assert dict(run(spark, tmp_path, "j8_kmer_hits")) == {i: n for i, n in hits.items() if n >= 2}


def test_overrepresented_counts_every_read(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter(seq(t) for _, t in TEXTS)
    want = sorted(n.items(), key=lambda x: (-x[1], x[0].encode()))
    assert any("é" in s for s, _ in want) and run(spark, tmp_path, "a6_overrepresented") == want


def test_samples_of_the_reference_hold_all_of_few_reads(spark, tmp_path):
    texts = [(i, f"Ab c{'xyz' * (i % 600)}") for i in range(700)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(run(spark, tmp_path, "w7_first_reads")) == 700
    assert run(spark, tmp_path, "a5_duplication") == [(700, 600, 1 - 600 / 700)]
    assert dict(run(spark, tmp_path, "a6_kmer_counts")) == Counter(k for _, t in texts for k in kmers(seq(t), 7))


def test_first_reads_are_not_gathered_in_one_task(spark):
    rows = [(f, r * 97 % 50_000, m, f"{f}/{r}/{m}") for f in (0, 1) for r in range(9_000) for m in (1, 2)] + [(0, None, 1, "null")]
    df = spark.createDataFrame(rows, "file_idx int, rec_no long, mate int, seq string").repartition(6)
    want = [r[3] for r in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))]
    for n in (0, 1, 4_000, 18_001, 18_002, 30_000, len(rows), 10**6):
        assert sorted(r.seq for r in Q.sample(df, n).collect()) == sorted(want[:n]), n
    per_task = Q.sample(df, 30_000).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) > 3 and max(r["count"] for r in per_task) < 15_000
    same = spark.range(50).select(F.lit(0).alias("file_idx"), F.lit(7).alias("rec_no"), F.lit(1).alias("mate"), "id")
    assert Q.sample(same, 20).count() == 20


def test_kmers_of_any_length_and_blocks(spark, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ACGTacgtACGTN\u00e9") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", None, "ACGT" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "seq string")
    for k in (1, 2, 7, 11, 16, 31, 33):
        assert dict(tuple(r) for r in Q.kmer_counts(df, k).collect()) == Counter(x for t in texts for x in kmers(t or "", k)), k
    monkeypatch.setattr(Q, "BLOCK", 50)
    codes = [int(c) for part in Q.packed_kmers(pa.array(["ACGT", *texts]).slice(1), 7) for c in part]
    spell = lambda c: "".join("ACGT"[c >> 2 * i & 3] for i in range(6, -1, -1))
    assert Counter(map(spell, codes)) == Counter(x for t in texts for x in kmers(t or "", 7))
