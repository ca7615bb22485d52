import random
from collections import Counter

from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators import alignment as A
from helixgrid.operators import annotation as N
from helixgrid.operators import contamination as C
from helixgrid.operators import dna as D
from helixgrid.operators import fastq as Q
from helixgrid.operators import intervals as I
from helixgrid.operators import snapshot as S
from helixgrid.sinks.svg import pack_lanes


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_cigar_walks(spark):
    blocks = one(spark, G.aligned_blocks(F.lit("5S10M2I3D100N7M"), F.lit(100)))
    assert [tuple(b) for b in blocks] == [(100, 110), (213, 220)]
    assert [tuple(b) for b in one(spark, G.introns(F.lit("5S10M2I3D100N7M"), F.lit(100)))] == [(113, 213)]
    assert one(spark, G.aligned_length(F.lit("5S10M2I3D100N7M"))) == 20 and one(spark, G.reference_span(F.lit("5S10M2I3D100N7M"))) == 120
    assert one(spark, G.match_span(F.lit("5S"), F.lit(3))) is None
    assert len(one(spark, G.md_elements(F.lit("10A5^AC2G1")))) == 7


def test_read_functions(spark):
    assert one(spark, G.read_name(F.lit("@@ read7/1 extra"))) == "read7"
    assert one(spark, G.reverse_complement(F.lit("acgtU"))) == "AACGT"
    assert one(spark, G.kmers(F.lit("ACGTN"), 4)) == ["ACGT"] and one(spark, G.kmers(F.lit("AC"), 4)) == []
    assert one(spark, G.poly_tail(F.lit("C" + "a" * 12), "A")) and not one(spark, G.poly_tail(F.lit("C" + "A" * 11), "A"))
    assert one(spark, G.phred(F.lit("I!"))) == [40, 0] and one(spark, G.gc_percent(F.lit(""))) == 0
    assert [one(spark, G.is_autosome(F.lit(c))) for c in ("chr1", "22", "chr23", "X", "chr0")] == [True, True, False, False, False]


def test_fastq_summary_and_nx(spark):
    reads = spark.createDataFrame([("ACGTNN", [40] * 6), ("ACGTAA", [0] * 6)], "seq string, qual array<int>")
    s = Q.summary(reads).first()
    assert (s.total_reads, s.total_bases, s.n_reads) == (2, 12, 1)
    assert {r.mean_quality: r["count"] for r in Q.quality_histogram(reads).collect()} == {40: 1, 0: 1}
    lengths = spark.createDataFrame([(100, 1), (200, 1), (700, 1), (1000, 1)], "length int, count long")
    nx = {r.x: r.length for r in Q.nx(lengths).collect()}
    assert nx[50] == 1000 and nx[75] == 700


def test_accuracy(spark):
    df = spark.createDataFrame([(0.02,), (0.01,), (0.05,), (None,)], "de double")
    r = A.accuracy_summary(df).first()
    assert r.n == 3 and abs(r["mean"] - 0.9733333) < 1e-6 and r["median"] == 0.98
    assert A.accuracy_summary(spark.createDataFrame([(0.01,), (0.01,), (0.03,)], "de double")).first()["mode"] == 0.99
    assert A.insert_metrics(spark.createDataFrame([], "insert_size int, count long")).count() == 0


def test_intervals(spark):
    df = spark.createDataFrame([("c", 20, 30), ("c", 10, 15), ("c", 14, 25), ("d", 1, 2), ("d", 2, 3), ("d", 5, 6)], "chrom string, start long, end long")
    assert sorted(tuple(r) for r in I.merge_intervals(df).collect()) == [("c", 10, 30), ("d", 1, 3), ("d", 5, 6)]
    a = spark.createDataFrame([("c", i, i + 37) for i in range(0, 500, 13)], "chrom string, s long, e long")
    b = spark.createDataFrame([("c", i, i + 91, i) for i in range(0, 600, 29)], "chrom string, rs long, re long, tag int")
    want = sum(x < j + 91 and j < x + 37 for x in range(0, 500, 13) for j in range(0, 600, 29))
    for size in (1, 7, 64, 10_000):
        got = I.range_join(a, b, "chrom", ("s", "e"), ("rs", "re"), size)
        assert got.count() == want == got.distinct().count()


def test_count_pairs_moves_no_pair_after_the_join(spark):
    rng = random.Random(7)
    left = [(rng.choice("xyz"), f"q{rng.randint(0, 30)}", s, s + rng.randint(0, 40)) for s in (rng.randint(0, 200) for _ in range(300))]
    left += left[:40] + [("y" if c == "x" else "x", *r) for c, *r in left[:60]] + [(None, "q0", 5, 9), ("x", None, 5, 9)]
    right = [(rng.choice("xyz"), i, s, s + rng.randint(0, 60)) for i, s in ((rng.randint(0, 150), rng.randint(0, 220)) for _ in range(90))]
    right += right[:20] + [("z" if c == "x" else "x", *r) for c, *r in right[:15]] + [("x", None, 0, 90), ("y", None, 3, 50), (None, 1, 0, 90)]
    want = Counter((q, s, e, i) for c, q, s, e in left for d, i, f, g in right if c and c == d and s < e and f < g and s < g and f < e)
    a, b = spark.createDataFrame(left, "chrom string, q string, s long, e long"), spark.createDataFrame(right, "chrom string, id int, f long, g long")
    for size in (1, 16, 1000):
        got = I.count_pairs(a, b, "chrom", ["q", "s", "e"], "id", ("s", "e"), ("f", "g"), size)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(want) and {r[:4]: r[4] for r in rows} == want
    # every right id has one interval: 600 x 400 pairs come out of the join, and no shuffle carries them
    a = spark.range(600).selectExpr("'x' as chrom", "concat('q', id) as q", "id % 3 as s", "id % 3 + 20 as e")
    b = spark.range(400).selectExpr("'x' as chrom", "id", "id % 5 as f", "id % 5 + 20 as g")
    got = I.count_pairs(a, b, "chrom", ["q", "s", "e"], "id", ("s", "e"), ("f", "g"), 64)
    before = moved(spark)
    assert got.count() == 240_000 and moved(spark) - before < 5_000


def test_count_pairs_joins_lists_not_pairs(spark):
    # names of three intervals and features of one bin, in more than one list each; some rows twice, a null on either side
    a = spark.range(600).selectExpr("'x' as chrom", "concat('q', nullif(id, 7)) as q", "id % 3 as s", "id % 3 + 20 as e")
    b = spark.range(400).selectExpr("'x' as chrom", "nullif(id, 9) as id", "id % 5 as f", "id % 5 + 20 as g")
    got = I.count_pairs(a.union(a.filter("s = 1")), b.union(b.filter("f = 2")), "chrom", ["q", "s", "e"], "id", ("s", "e"), ("f", "g"), 64)
    by = got.groupBy((F.col("s") == 1).alias("u"), (F.coalesce("id", F.lit(9)) % 5 == 2).alias("v")).agg(F.count(F.lit(1)), F.countDistinct(F.coalesce("q", F.lit("")), F.coalesce("id", F.lit(-1))), F.min("n"), F.max("n"))
    assert {tuple(r) for r in by.collect()} == {(u, v, k, k, n, n) for u, v, k, n in ((False, False, 128_000, 1), (False, True, 32_000, 2), (True, False, 64_000, 2), (True, True, 16_000, 4))}
    run = got._jdf.queryExecution()
    assert run.toRdd().count() == 240_000 and 0 < joined(run.executedPlan()) < 1_000


def joined(plan):
    """Rows that the joins of a plan that has run gave."""
    kind = plan.getClass().getSimpleName()
    if kind.startswith("AdaptiveSparkPlan"):
        return joined(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return joined(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if kind.endswith("JoinExec") else 0
    return own + sum(joined(plan.children().apply(i)) for i in range(plan.children().size()))


def moved(spark):
    """Shuffle records that the session's stages have written."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_kmers_and_contamination(spark):
    ref = spark.createDataFrame([("ACGTAAAA",)], "seq string")
    known = {r.kmer for r in C.reference_kmers(ref, 4).collect()}
    assert {"TTTT", "ACGT"} <= known and "CCCC" not in known
    rec = spark.createDataFrame([(i, 0, "c" if i < 7 else "r", i * 10, "5M") for i in range(10)], "id int, flag int, contig string, pos0 long, cigar string")
    hits = C.interval_hits(rec, spark.createDataFrame([("c", 0, 25)], "chrom string, start long, end long"), ["id"], 16)
    r = C.summary(rec, hits, ["id"], ("r", "c_none")).first()
    assert (r.total, r.rdna_interval, r.rdna_contig, r.rdna) == (10, 3, 3, 6)


def test_depth_keeps_empty_spans_and_overlapping_targets(spark):
    rec = spark.createDataFrame([(0, "c", 100, 60, "5M2I3D2N5M"), (0, "c", 102, 60, "4M"), (4, "c", 0, 60, "9M")], "flag int, contig string, pos0 long, mapq int, cigar string")
    segs = D.segments(rec)
    assert sorted((r.start, r.end, r.depth) for r in segs.collect()) == [(100, 102, 1), (102, 105, 2), (105, 106, 1), (110, 115, 1)]
    contigs = spark.createDataFrame([("c", 200), ("e", 50)], "contig string, length long")
    assert {r.depth: r.bases for r in D.depth_histogram(segs, contigs).collect()} == {0: 239, 1: 8, 2: 3}
    spans = spark.createDataFrame([("c", 0, 100), ("c", 101, 104), ("c", 103, 200)], "contig string, start long, end long")
    assert [r.depth_bases for r in D.span_depth(segs, spans, 64).orderBy("start").collect()] == [0, 5, 10]


def test_feature_classes(spark):
    tx = spark.createDataFrame([("t", "g", "chr1", "+", [(100, 200), (300, 400)], 120, 350)], "transcript_id string, gene_id string, chrom string, strand string, exons array<struct<start:long,end:long>>, cds_start long, cds_end long")
    rows = N.feature_index(tx).collect()
    at = lambda p: next(r.region for r in rows if r.start <= p < r.end)
    assert [at(p) for p in (110, 130, 210, 360, 50, 450)] == ["5'UTR_Exons", "CDS_Exons", "Introns", "3'UTR_Exons", "TSS_up_1kb", "TES_down_1kb"]


def test_pileup_and_regions(spark):
    rec = spark.createDataFrame([("r", 0, "chr1", 100, 60, "4M2I2M3D3M", "ACGTGGACAAA")], "qname string, flag int, contig string, pos0 long, mapq int, cigar string, seq string")
    p = {r.pos: r for r in S.pileup(rec, 90, 130).collect()}
    assert p[103].ins == 1 and p[103].ins_len == 2 and p[106].del_starts == 1 and [p[i].del_spanning for i in (106, 107, 108)] == [1, 1, 1]
    assert [p[i][f"n_{b}"] for i, b in ((100, "a"), (101, "c"), (104, "a"), (109, "a"))] == [1, 1, 1, 1]
    c = {r.pos: r.depth for r in S.coverage(rec, 98, 114).collect()}
    assert c[99] == 0 and c[100] == 1 and c[106] == 0 and c[111] == 1 and c[112] == 0
    assert S.parse_region("chr1:100-200") == ("chr1", 99, 200) and S.parse_region("chr1:100,000") == ("chr1", 99_499, 100_500)
    assert pack_lanes([(0, 10), (5, 15), (10, 20)]) == [0, 1, 0]
    svg = S.snapshot(rec, None, None, "1:91-130")
    assert svg.startswith("<svg") and "deletion" not in svg
