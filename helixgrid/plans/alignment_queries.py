"""Queries over alignments: filters, projections, flag statistics, inserts, accuracy, depth, contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators import alignment as A
from helixgrid.operators import contamination as C
from helixgrid.operators import dna as D
from helixgrid.operators import intervals as I
from helixgrid.operators import rna as R
from helixgrid.plans import fixtures as X
from helixgrid.plans.fixtures import load, sql
from helixgrid.plans.registry import register
from helixgrid.sources.intervals import targets

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
KEYS = ", ".join(KEY)
NORM = "regexp_replace(lower({0}), '^chr', '')"
PRIMARY = "(flag & 2308) = 0"


def aln(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, X.ALN)


def alnc(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, X.ALNC)


@register("p1_normalize_chrom", sql("SELECT contig, regexp_replace(lower(contig), '^chr', '') AS chrom, coalesce(TRY_CAST(regexp_replace(lower(contig), '^chr', '') AS INT) BETWEEN 1 AND 22, false) AS autosome, count(*) AS n FROM aln GROUP BY contig", aln=X.ALN))
def p1(s, d):
    return aln(s, d).groupBy("contig").agg(F.count(F.lit(1)).alias("n")).select("contig", G.normalize_chrom("contig").alias("chrom"), G.is_autosome("contig").alias("autosome"), "n")


@register("p2_aligned_blocks", sql(f'SELECT {KEYS}, start, "end" FROM b', b=X.BLOCKS))
def p2(s, d):
    return alnc(s, d).select(*KEY, F.explode(G.aligned_blocks("cigar", "pos0")).alias("b")).select(*KEY, "b.start", "b.end")


@register("p3_spans", sql(f"SELECT {KEYS}, CASE WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END AS reference_span, pos0 AS match_start, pos0 + CASE WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END AS match_end FROM a", a=X.ALNC))
def p3(s, d):
    span = G.match_span("cigar", "pos0")
    return alnc(s, d).select(*KEY, G.reference_span("cigar").alias("reference_span"), span["start"].alias("match_start"), span["end"].alias("match_end"))


@register("p4_alignment_start", sql(f"SELECT {KEYS}, pos0, pos0 + 1 AS pos1 FROM a", a=X.ALN))
def p4(s, d):
    return aln(s, d).select(*KEY, "pos0", (F.col("pos0") + 1).alias("pos1"))


@register("p5_aligned_length", sql(f"SELECT {KEYS}, CAST(CASE WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END AS BIGINT) AS aligned FROM a", a=X.ALNC))
def p5(s, d):
    return alnc(s, d).select(*KEY, G.aligned_length("cigar").alias("aligned"))


@register("p13_read_names", sql("SELECT DISTINCT qname, '@' || qname || '/1 comment' AS raw, qname AS name FROM a", a=X.ALN))
def p13(s, d):
    names = aln(s, d).select("qname").distinct().withColumn("raw", F.concat(F.lit("@"), "qname", F.lit("/1 comment")))
    return names.select("qname", "raw", G.read_name("raw").alias("name"))


@register("p20_accuracy", sql(f"SELECT {KEYS}, least(greatest(1 - de, 0), 1) AS accuracy, CAST(floor(least(greatest(1 - de, 0), 1) * 10000 + 0.5) AS INT) AS bin FROM a", a=X.ALNC))
def p20(s, d):
    return alnc(s, d).select(*KEY, G.accuracy("de").alias("accuracy"), G.accuracy_bin("de").alias("bin"))


@register("p23_splice_junctions", sql(f"SELECT {KEYS}, pos0 + 10 AS start, pos0 + 110 AS \"end\" FROM a WHERE l_linenumber % 4 = 2", a=X.ALNC))
def p23(s, d):
    return alnc(s, d).select(*KEY, F.explode(G.introns("cigar", "pos0")).alias("j")).select(*KEY, "j.start", "j.end")


@register("p28_midpoint", sql(f"SELECT {KEYS}, pos0 + mlen // 2 AS mid FROM a", a=X.ALN))
def p28(s, d):
    return aln(s, d).select(*KEY, G.midpoint("pos0", F.col("pos0") + F.col("mlen")).alias("mid"))


REASON = "CASE WHEN (flag & 4) <> 0 THEN 'unmapped' WHEN (flag & 2304) <> 0 THEN 'secondary' WHEN (flag & 1536) <> 0 THEN 'qc_fail_or_duplicate' WHEN mapq < 10 THEN 'low_mapq' ELSE 'passed' END"


@register("f1_rna_filter", sql(f"SELECT {REASON} AS reason, count(*) AS count FROM a GROUP BY 1", a=X.ALN))
def f1(s, d):
    return R.filter_counts(aln(s, d))


@register("f1_read2_only", sql(f"SELECT {KEYS} FROM a WHERE {REASON} = 'passed' AND (flag & 128) <> 0", a=X.ALN))
def f1b(s, d):
    return aln(s, d).filter(R.fail_reason(10, True).isNull()).select(*KEY)


@register("f2_dna_filter", sql(f"SELECT {KEYS} FROM a WHERE {PRIMARY}", a=X.ALN))
def f2(s, d):
    return D.passing(aln(s, d)).select(*KEY)


@register("f3_contamination_filter", sql(f"SELECT {KEYS} FROM a WHERE (flag & 2304) = 0", a=X.ALN))
def f3(s, d):
    return C.primary(aln(s, d)).select(*KEY)


@register("f4_snapshot_filter", sql(f"SELECT {KEYS} FROM a WHERE {PRIMARY} AND mapq >= 20", a=X.ALN))
def f4(s, d):
    return D.passing(aln(s, d), 20).select(*KEY)


@register("f5_low_mapq", sql("SELECT count(*) FILTER (mapq < 10) AS low_mapq FROM a", a=X.ALN))
def f5(s, d):
    return A.low_mapq(aln(s, d), 10)


@register("f6_kmer_screen_predicate", sql("SELECT count(*) AS all_reads, count(*) FILTER ((flag & 4) <> 0) AS unmapped, count(*) FILTER ((flag & 4) <> 0 OR mapq < 10) AS low_mapq FROM a", a=X.ALN))
def f6(s, d):
    return aln(s, d).agg(*[F.count_if(C.to_screen(m)).alias(n) for m, n in (("all", "all_reads"), ("unmapped", "unmapped"), ("low_mapq", "low_mapq"))])


@register("f7_window_ownership", sql("SELECT contig, pos0 // 1000 AS window_no, count(*) AS n FROM a GROUP BY 1, 2", a=X.ALN))
def f7(s, d):
    return aln(s, d).groupBy("contig", F.floor(F.col("pos0") / 1000).alias("window_no")).agg(F.count(F.lit(1)).alias("n"))


@register("f11_autosomal", sql("SELECT contig, count(*) AS n FROM a WHERE contig <> 'chrM' GROUP BY contig", a=X.ALN))
def f11(s, d):
    return R.autosomal(aln(s, d)).groupBy("contig").agg(F.count(F.lit(1)).alias("n"))


@register("f12_fragment_filter", sql(f"SELECT {KEYS} FROM a WHERE (flag & {4 + 256 + 512 + 1024 + 2048}) = 0 AND mapq >= 30", a=X.ALN))
def f12(s, d):
    return aln(s, d).filter(R.fail_reason(30).isNull()).select(*KEY)


@register("f16_region_overlap", sql("SELECT tx_id, e1s, e1e FROM t WHERE chrom = 'chr5' AND e1e > 1000 AND e1s < 2000", t=X.TX))
def f16(s, d):
    return load(s, d, X.TX).filter((F.col("chrom") == "chr5") & (F.col("e1e") > 1000) & (F.col("e1s") < 2000)).select("tx_id", "e1s", "e1e")


@register("a10_flagstat", sql("""SELECT count(*) AS total, count(*) FILTER ((flag & 4) = 0) AS mapped, count(*) FILTER ((flag & 4) <> 0) AS unmapped, count(*) FILTER ((flag & 2304) = 0) AS "primary",
 count(*) FILTER ((flag & 256) <> 0) AS secondary, count(*) FILTER ((flag & 2048) <> 0) AS supplementary, count(*) FILTER ((flag & 1024) <> 0) AS duplicates, count(*) FILTER ((flag & 512) <> 0) AS qc_fail,
 count(*) FILTER ((flag & 1) <> 0) AS paired, count(*) FILTER ((flag & 3) = 3) AS proper, count(*) FILTER ((flag & 13) = 9) AS singleton, count(*) FILTER ((flag & 13) = 5) AS orphan, count(*) FILTER ((flag & 15) = 1) AS discordant FROM a""", a=X.ALN))
def a10(s, d):
    return A.flagstat(aln(s, d))


@register("a11_mapq_histogram", sql("SELECT mapq, count(*) AS count FROM a GROUP BY mapq", a=X.ALN))
def a11(s, d):
    return A.mapq_histogram(aln(s, d))


@register("a11_insert_histogram", sql("SELECT tlen AS insert_size, count(*) AS count FROM a WHERE tlen > 0 GROUP BY tlen", a=X.ALN))
def a11b(s, d):
    return A.insert_histogram(aln(s, d))


OPS = """SELECT 'M' AS op, mlen AS len FROM a WHERE l_linenumber % 4 = 0
 UNION ALL SELECT 'S', 5 FROM a WHERE l_linenumber % 4 = 1 UNION ALL SELECT 'M', mlen FROM a WHERE l_linenumber % 4 = 1
 UNION ALL SELECT 'M', 10 FROM a WHERE l_linenumber % 4 = 2 UNION ALL SELECT 'N', 100 FROM a WHERE l_linenumber % 4 = 2 UNION ALL SELECT 'M', mlen - 10 FROM a WHERE l_linenumber % 4 = 2
 UNION ALL SELECT 'M', 10 FROM a WHERE l_linenumber % 4 = 3 UNION ALL SELECT 'I', 2 FROM a WHERE l_linenumber % 4 = 3 UNION ALL SELECT 'M', 5 FROM a WHERE l_linenumber % 4 = 3
 UNION ALL SELECT 'D', 3 FROM a WHERE l_linenumber % 4 = 3 UNION ALL SELECT 'M', mlen - 15 FROM a WHERE l_linenumber % 4 = 3"""


@register("a12_cigar_totals", sql(f"SELECT op, count(*) AS operations, CAST(sum(len) AS BIGINT) AS bases FROM ({OPS}) GROUP BY op", a=X.ALNC))
def a12(s, d):
    return A.cigar_totals(alnc(s, d))


@register("a13_contig_counts", sql(f"""SELECT CASE WHEN (flag & 4) <> 0 THEN '*' ELSE contig END AS contig, count(*) AS records, count(*) FILTER ((flag & 4) = 0) AS mapped, count(*) FILTER ({PRIMARY}) AS primary_mapped,
 CAST(sum(CASE WHEN (flag & 4) <> 0 THEN 0 WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END) AS BIGINT) AS reference_bases FROM a GROUP BY 1""", a=X.ALNC))
def a13(s, d):
    return A.contig_counts(alnc(s, d))


ACC = "SELECT CAST(floor(least(greatest(1 - de, 0), 1) * 10000 + 0.5) AS INT) AS bin, count(*) AS count FROM a GROUP BY 1"


@register("a14_accuracy_histogram", sql(ACC, a=X.ALNC))
def a14(s, d):
    return A.accuracy_histogram(alnc(s, d))


@register("a14_accuracy_summary", sql("""SELECT (SELECT count(*) FROM a) AS n, (SELECT avg(least(greatest(1 - de, 0), 1)) FROM a) AS mean, (SELECT bin / 10000 FROM h ORDER BY count DESC, bin LIMIT 1) AS mode,
 (SELECT min(bin) / 10000 FROM (SELECT bin, sum(count) OVER (ORDER BY bin) AS cum, sum(count) OVER () AS n FROM h) WHERE cum >= floor((n - 1) * 0.5 + 0.5) + 1) AS median""", a=X.ALNC, h=ACC))
def a14b(s, d):
    return A.accuracy_summary(alnc(s, d))


INS = "SELECT tlen AS x, count(*) AS c FROM a WHERE tlen > 0 GROUP BY tlen"
_CLASS = ", ".join(f"CAST(sum(CASE WHEN x BETWEEN {lo} AND {hi} THEN c ELSE 0 END) AS BIGINT) AS {k}_count" for k, (lo, hi) in A.INSERT_CLASSES.items())


@register("a15_insert_metrics", sql(f"""SELECT k.*, short_cfdna_count / nullif(mono_cfdna_count, 0) AS cfdna_ratio, mono_nucleosomal_count / nullif(di_nucleosomal_count, 0) AS mono_di_ratio,
 sub_nucleosomal_count / total_inserts AS short_fraction, mono_nucleosomal_count / total_inserts AS mono_fraction, di_nucleosomal_count / total_inserts AS di_fraction,
 (SELECT x FROM sm WHERE x BETWEEN 140 AND 200 AND v > 0 ORDER BY v DESC, x LIMIT 1) AS mono_nucleosomal_peak, (SELECT x FROM sm WHERE x BETWEEN 300 AND 450 AND v > 0 ORDER BY v DESC, x LIMIT 1) AS di_nucleosomal_peak FROM k""",
    a=X.ALN, h=INS, k=f"SELECT CAST(sum(c) AS BIGINT) AS total_inserts, {_CLASS} FROM h", sm="SELECT CAST(r AS INT) AS x, sum(coalesce(c, 0)) OVER (ORDER BY r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS v FROM range(137, 454) t(r) LEFT JOIN h ON h.x = r"))
def a15(s, d):
    return A.insert_metrics(A.insert_histogram(aln(s, d)))


@register("w6_smoothed_inserts", sql("SELECT CAST(r AS INT) AS insert_size, sum(coalesce(c, 0)) OVER (ORDER BY r ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0 AS smooth FROM range(137, 454) t(r) LEFT JOIN h ON h.x = r", a=X.ALN, h=INS))
def w6(s, d):
    from pyspark.sql import Window

    hist = A.insert_histogram(aln(s, d))
    line = s.range(137, 454).select(F.col("id").cast("int").alias("insert_size")).join(hist, "insert_size", "left")
    return line.select("insert_size", (F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("insert_size").rowsBetween(-3, 3)) / 7.0).alias("smooth"))


MD_ROWS = f"SELECT {KEYS}, qname, contig, pos0, flag, mapq, cigar, mlen, concat(CAST(mlen - 6 - CASE WHEN l_linenumber % 4 = 3 THEN 15 ELSE 0 END AS STRING), 'A5') AS tail FROM ({X.ALNC}) z"
MD = f"SELECT *, CASE WHEN l_linenumber % 4 = 3 THEN concat('15^ACG', tail) ELSE tail END AS md, repeat('C', CAST(mlen + CASE WHEN l_linenumber % 4 = 1 THEN 5 WHEN l_linenumber % 4 = 3 THEN 2 ELSE 0 END AS INT)) AS seq FROM ({MD_ROWS}) y"


@register("p21_md_elements", sql(f"SELECT {KEYS}, md, CASE WHEN l_linenumber % 4 = 3 THEN 5 ELSE 3 END AS elements FROM m", m=MD))
def p21(s, d):
    return load(s, d, MD).select(*KEY, "md", F.size(G.md_elements("md")).alias("elements"))


@register("p22_md_substitutions", sql("SELECT CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS mate, CAST(mlen - 6 + CASE WHEN l_linenumber % 4 = 1 THEN 5 WHEN l_linenumber % 4 = 3 THEN 2 ELSE 0 END AS INT) AS cycle, 'A' AS ref, 'C' AS query, count(*) AS n FROM m GROUP BY 1, 2", m=MD))
def p22(s, d):
    return A.md_substitutions(load(s, d, MD)).groupBy("mate", "cycle", "ref", "query").agg(F.count(F.lit(1)).alias("n"))


@register("a16_mismatch_cycles", sql("SELECT CASE WHEN (flag & 128) <> 0 THEN 2 ELSE 1 END AS mate, CAST(mlen - 6 + CASE WHEN l_linenumber % 4 = 1 THEN 5 WHEN l_linenumber % 4 = 3 THEN 2 ELSE 0 END AS INT) AS cycle, count(*) AS mismatches FROM m GROUP BY 1, 2", m=MD))
def a16b(s, d):
    return A.mismatch_cycles(load(s, d, MD)).groupBy("mate", "cycle").agg(F.count(F.lit(1)).alias("mismatches"))


@register("p35_clip_bases", sql(f"SELECT {KEYS}, CASE WHEN l_linenumber % 4 = 1 THEN 'S' ELSE 'I' END AS op, CASE WHEN l_linenumber % 4 = 1 THEN pos0 ELSE pos0 + 10 END AS ref, CASE WHEN l_linenumber % 4 = 1 THEN 'CCCCC' ELSE 'CC' END AS bases FROM m WHERE l_linenumber % 4 IN (1, 3)", m=MD))
def p35(s, d):
    from helixgrid.operators.snapshot import query_bases

    return query_bases(load(s, d, MD)).select(*KEY, "op", "ref", "bases")


SEGS = """SELECT contig, posn AS start, nxt AS "end", depth FROM (SELECT contig, posn, lead(posn) OVER w AS nxt, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS depth
 FROM (SELECT contig, posn, sum(d) AS d FROM (SELECT contig, start AS posn, 1 AS d FROM b WHERE (flag & 2308) = 0 UNION ALL SELECT contig, "end", -1 FROM b WHERE (flag & 2308) = 0) GROUP BY contig, posn) WINDOW w AS (PARTITION BY contig ORDER BY posn)) WHERE nxt IS NOT NULL AND depth > 0"""
HIST = f'SELECT CAST(depth AS BIGINT) AS depth, CAST(sum("end" - start) AS BIGINT) AS bases FROM segs GROUP BY depth UNION ALL SELECT 0, (SELECT count(DISTINCT contig) * {X.CONTIG_LENGTH} FROM a) - (SELECT CAST(sum("end" - start) AS BIGINT) FROM segs)'
LEVEL_SQL = ", ".join(["CAST(coalesce(sum(w * depth), 0) AS BIGINT) AS depth_bases"] + [f"CAST(coalesce(sum(CASE WHEN depth >= {n} THEN w ELSE 0 END), 0) AS BIGINT) AS bases_ge_{n}" for n in D.LEVELS])


@register("w1_depth_segments", sql('SELECT contig, start, "end", CAST(depth AS BIGINT) AS depth FROM segs', a=X.ALNC, b=X.BLOCKS, segs=SEGS))
def w1(s, d):
    return D.segments(alnc(s, d)).withColumn("depth", F.col("depth").cast("bigint"))


@register("a17_depth_histogram", sql("SELECT * FROM h", a=X.ALNC, b=X.BLOCKS, segs=SEGS, h=HIST))
def a17(s, d):
    return D.depth_histogram(D.segments(alnc(s, d)), load(s, d, X.CONTIGS))


@register("a18_contig_depth", sql(f'SELECT c.contig, CAST({X.CONTIG_LENGTH} AS BIGINT) AS length, {LEVEL_SQL} FROM (SELECT DISTINCT contig FROM a) c LEFT JOIN (SELECT *, "end" - start AS w FROM segs) g ON g.contig = c.contig GROUP BY c.contig', a=X.ALNC, b=X.BLOCKS, segs=SEGS))
def a18(s, d):
    return D.contig_depth(D.segments(alnc(s, d)), load(s, d, X.CONTIGS))


WIN = f'SELECT contig, CAST(r AS BIGINT) AS start, CAST(least(r + 1000, {X.CONTIG_LENGTH}) AS BIGINT) AS "end" FROM (SELECT DISTINCT contig FROM a), range(0, {X.CONTIG_LENGTH}, 1000) t(r)'
WDEPTH = f'SELECT n.contig, n.start, n."end", {LEVEL_SQL} FROM win n LEFT JOIN (SELECT n.contig, n.start, g.depth, least(g."end", n."end") - greatest(g.start, n.start) AS w FROM win n JOIN segs g ON g.contig = n.contig AND g.start < n."end" AND n.start < g."end") g ON g.contig = n.contig AND g.start = n.start GROUP BY n.contig, n.start, n."end"'


@register("s7_windows", sql("SELECT * FROM win", a=X.ALN, win=WIN))
def s7(s, d):
    return I.windows(load(s, d, X.CONTIGS), 1000)


@register("j7_window_depth", sql("SELECT * FROM wd", a=X.ALNC, b=X.BLOCKS, segs=SEGS, win=WIN, wd=WDEPTH))
def j7(s, d):
    return D.span_depth(D.segments(alnc(s, d)), I.windows(load(s, d, X.CONTIGS), 1000), 1000)


TNAMED = 'SELECT chrom AS contig, start, "end", coalesce(name, concat(chrom, \':\', CAST(start AS STRING), \'-\', CAST("end" AS STRING))) AS name FROM (' + X.TARGETS + ") z"


@register("a18_target_depth", sql(f'SELECT t.contig, t.start, t."end", t.name, {LEVEL_SQL} FROM t LEFT JOIN (SELECT t.contig, t.start, g.depth, least(g."end", t."end") - greatest(g.start, t.start) AS w FROM t JOIN segs g ON g.contig = t.contig AND g.start < t."end" AND t.start < g."end") g ON g.contig = t.contig AND g.start = t.start GROUP BY t.contig, t.start, t."end", t.name', a=X.ALNC, b=X.BLOCKS, segs=SEGS, t=TNAMED))
def a18b(s, d):
    return D.span_depth(D.segments(alnc(s, d)), load(s, d, TNAMED), 500)


@register("s11_targets", sql("SELECT * FROM t", t=TNAMED))
def s11(s, d):
    rows = load(s, d, X.TARGETS)
    fields = [F.col("chrom"), F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("name", F.lit(""))]
    return targets(rows.select(F.concat_ws("\t", *fields).alias("value")))


_BREADTH = ", ".join(f"100 * sum(CASE WHEN depth >= {n} THEN bases ELSE 0 END) / sum(bases) AS breadth_{n}" for n in D.LEVELS)


@register("a19_depth_summary", sql(f"SELECT CAST(sum(bases) AS BIGINT) AS reference_bases, sum(depth * bases) / sum(bases) AS mean_depth, (SELECT min(depth) FROM (SELECT depth, sum(bases) OVER (ORDER BY depth) AS cum, sum(bases) OVER () AS n FROM h) WHERE cum >= floor((n - 1) * 0.5 + 0.5) + 1) AS median_depth, {_BREADTH} FROM h", a=X.ALNC, b=X.BLOCKS, segs=SEGS, h=HIST))
def a19(s, d):
    return D.summary(D.depth_histogram(D.segments(alnc(s, d)), load(s, d, X.CONTIGS)))


@register("a20_merge_inputs", sql(f"SELECT contig, max(length) AS length, CAST(sum(depth_bases) AS BIGINT) AS depth_bases, {', '.join(f'CAST(sum(bases_ge_{n}) AS BIGINT) AS bases_ge_{n}' for n in D.LEVELS)} FROM (SELECT c.contig, i, CAST({X.CONTIG_LENGTH} AS BIGINT) AS length, {LEVEL_SQL} FROM (SELECT DISTINCT contig FROM a) c CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) q LEFT JOIN (SELECT *, \"end\" - start AS w FROM segs) g ON g.contig = c.contig GROUP BY c.contig, i) GROUP BY contig", a=X.ALNC, b=X.BLOCKS, segs=SEGS))
def a20(s, d):
    one = D.contig_depth(D.segments(alnc(s, d)), load(s, d, X.CONTIGS))
    return D.merge_inputs(one.unionByName(one))


GCW = f"SELECT (start // 10 * 7 + CAST(regexp_replace(replace(contig, 'M', '25'), '^chr', '') AS INT)) % 101 / 100.0 AS gc, depth_bases / (\"end\" - start) AS mean_depth FROM wd"
GCB = """SELECT CAST(p AS INT) AS gc_percent, coalesce(n, 0) AS window_count, coalesce(m, 0.0) AS mean_depth, coalesce(m, 0.0) / nullif((SELECT avg(mean_depth) FROM gw), 0) AS normalized_coverage, coalesce(se, 0.0) AS standard_error
 FROM range(101) t(p) LEFT JOIN (SELECT CAST(least(floor(gc * 100 + 0.5), 100) AS INT) AS g, count(*) AS n, avg(mean_depth) AS m, coalesce(stddev_samp(mean_depth), 0) / sqrt(count(*)) AS se FROM gw GROUP BY 1) x ON g = p"""


def _gc_windows(s, d):
    wd = D.span_depth(D.segments(alnc(s, d)), I.windows(load(s, d, X.CONTIGS), 1000), 1000)
    no = F.regexp_replace(F.replace("contig", F.lit("M"), F.lit("25")), "^chr", "").cast("int")
    return wd.select((((F.floor(F.col("start") / 10) * 7 + no) % 101) / 100.0).alias("gc"), (F.col("depth_bases") / (F.col("end") - F.col("start"))).alias("mean_depth"))


@register("a21_gc_bias", sql("SELECT * FROM gb", a=X.ALNC, b=X.BLOCKS, segs=SEGS, win=WIN, wd=WDEPTH, gw=GCW, gb=GCB))
def a21(s, d):
    return D.gc_bias(_gc_windows(s, d))


@register("a22_gc_bias_checks", sql("""SELECT at_average, gc_average, mean_se, coalesce(at_average < 0.5 OR at_average > 1.8, false) AS at_warning, coalesce(gc_average < 0.5 OR gc_average > 1.8, false) AS gc_warning, coalesce(mean_se > 0.15, false) AS noise_warning
 FROM (SELECT avg(CASE WHEN gc_percent BETWEEN 20 AND 25 AND window_count > 0 THEN normalized_coverage END) AS at_average, avg(CASE WHEN gc_percent BETWEEN 60 AND 65 AND window_count > 0 THEN normalized_coverage END) AS gc_average, avg(CASE WHEN window_count > 1 THEN standard_error END) AS mean_se FROM gb)""", a=X.ALNC, b=X.BLOCKS, segs=SEGS, win=WIN, wd=WDEPTH, gw=GCW, gb=GCB))
def a22(s, d):
    return D.gc_bias_checks(D.gc_bias(_gc_windows(s, d)))


#: Pieces of a reference, which overlap each other; every text is one.
REF = f"SELECT concat('chr', CAST(read_id % 22 + 1 AS STRING)) AS contig, CAST(floor(read_id / 22) * 100 % 5000 AS BIGINT) AS start, seq FROM ({X.FQ}) f"
WGC = """SELECT contig, start, "end", mean_depth, sum(g) / (sum(g) + sum(t)) AS gc FROM (SELECT contig, start, "end", mean_depth, length(p) - length(translate(p, 'GCgc', '')) AS g, length(p) - length(translate(p, 'ATUatu', '')) AS t
 FROM (SELECT w.contig, w.start, w."end", depth_bases / (w."end" - w.start) AS mean_depth, substr(seq, greatest(w.start, r.start) - r.start + 1, least(w."end", r.start + length(seq)) - greatest(w.start, r.start)) AS p FROM wd w JOIN ref r ON r.contig = w.contig AND r.start < w."end" AND w.start < r.start + length(seq)))
 GROUP BY contig, start, "end", mean_depth HAVING sum(g) + sum(t) > 0"""
GC_VIEWS = {"a": X.ALNC, "b": X.BLOCKS, "segs": SEGS, "win": WIN, "wd": WDEPTH, "ref": REF, "gw": WGC}


def _reference_gc(s, d):
    wd = D.span_depth(D.segments(alnc(s, d)), I.windows(load(s, d, X.CONTIGS), 1000), 1000)
    return D.window_gc(wd.select("contig", "start", "end", (F.col("depth_bases") / (F.col("end") - F.col("start"))).alias("mean_depth")), load(s, d, REF), 1000)


@register("j14_window_gc", sql("SELECT * FROM gw", **GC_VIEWS))
def j14(s, d):
    return _reference_gc(s, d)


@register("j14_gc_bias", sql("SELECT * FROM gb", **GC_VIEWS, gb=GCB))
def j14b(s, d):
    return D.gc_bias(_reference_gc(s, d))


MERGED = """SELECT chrom, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM c)) GROUP BY chrom, island"""


@register("j9_merge_intervals", sql("SELECT * FROM m", c=X.CONTAM, m=MERGED))
def j9(s, d):
    return I.merge_intervals(load(s, d, X.CONTAM))


@register("j4_interval_overlap", sql(f'SELECT DISTINCT {KEYS} FROM a WHERE EXISTS (SELECT 1 FROM c WHERE c.chrom = a.contig AND c.start < pos0 + CASE WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END AND pos0 < c."end")', a=X.ALNC, c=X.CONTAM))
def j4(s, d):
    return C.interval_hits(alnc(s, d), load(s, d, X.CONTAM), KEY, 256)


@register("j5_midpoint_in_interval", sql(f'SELECT DISTINCT {KEYS} FROM (SELECT *, pos0 + CASE WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END // 2 AS mid FROM a) q WHERE EXISTS (SELECT 1 FROM c WHERE c.chrom = q.contig AND c.start <= mid AND mid < c."end")', a=X.ALNC, c=X.CONTAM))
def j5(s, d):
    return C.midpoint_hits(alnc(s, d), load(s, d, X.CONTAM), KEY, 256)


@register("j6_contig_in_set", sql("SELECT count(*) AS reads, count(*) FILTER (contig = 'chrM') AS mito FROM a", a=X.ALN))
def j6(s, d):
    return R.mito_counts(aln(s, d))


@register("range_join_pairs", sql("SELECT qname, pos0, mlen, tx_id, count(*) AS n FROM a JOIN t ON a.contig = t.chrom AND a.pos0 < t.e1e AND a.pos0 + a.mlen > t.e1s GROUP BY ALL", a=X.ALN, t=X.TX))
def range_pairs(s, d):
    left = aln(s, d).select("qname", "pos0", "mlen", F.col("contig").alias("chrom"), (F.col("pos0") + F.col("mlen")).alias("stop"))
    return I.count_pairs(left, load(s, d, X.TX).select("chrom", "tx_id", "e1s", "e1e"), "chrom", ["qname", "pos0", "mlen"], "tx_id", ("pos0", "stop"), ("e1s", "e1e"), 64)


@register("a23_contamination", sql(f"""SELECT count(*) AS total, count(*) FILTER (contig = 'chrM') AS mito, count(*) FILTER (hit) AS rdna_interval, count(*) FILTER (contig IN ('chr3', 'chr9')) AS rdna_contig, count(*) FILTER (hit OR contig IN ('chr3', 'chr9')) AS rdna,
 count(*) FILTER (contig = 'chrM') / count(*) AS mito_fraction, count(*) FILTER (hit OR contig IN ('chr3', 'chr9')) / count(*) AS rdna_fraction
 FROM (SELECT contig, EXISTS (SELECT 1 FROM c WHERE c.chrom = a.contig AND c.start < pos0 + CASE WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END AND pos0 < c."end") AS hit FROM a WHERE (flag & 2304) = 0)""", a=X.ALNC, c=X.CONTAM))
def a23(s, d):
    records = alnc(s, d).withColumn("contig", F.when(F.col("contig") == "chrM", "MT").otherwise(F.col("contig")))
    return C.summary(records, C.interval_hits(records, load(s, d, X.CONTAM), KEY, 256), KEY, ("chr3", "CHR9"))


@register("u1_union_inputs", sql("SELECT file_idx, count(*) AS n FROM (SELECT 0 AS file_idx FROM a WHERE l_linenumber % 2 = 0 UNION ALL SELECT 1 FROM a WHERE l_linenumber % 2 = 1) GROUP BY file_idx", a=X.ALN))
def u1(s, d):
    a = aln(s, d)
    both = a.filter("l_linenumber % 2 = 0").withColumn("file_idx", F.lit(0)).unionByName(a.filter("l_linenumber % 2 = 1").withColumn("file_idx", F.lit(1)))
    return both.groupBy("file_idx").agg(F.count(F.lit(1)).alias("n"))


@register("w4_histogram_quantile", sql("SELECT min(mapq) AS quantile FROM (SELECT mapq, sum(n) OVER (ORDER BY mapq) AS cum, sum(n) OVER () AS total FROM (SELECT mapq, count(*) AS n FROM a GROUP BY mapq)) WHERE cum >= floor((total - 1) * 0.9 + 0.5) + 1", a=X.ALN))
def w4(s, d):
    return I.histogram_quantile(A.mapq_histogram(aln(s, d)), 0.9, "mapq")
