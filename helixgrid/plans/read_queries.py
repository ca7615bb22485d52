"""Queries over raw reads and k-mers."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators import contamination as C
from helixgrid.operators import fastq as Q
from helixgrid.plans import fixtures as X
from helixgrid.plans.fixtures import load, sql
from helixgrid.plans.registry import register

#: A-Z only, as the operators do.
UP = f"translate(seq, '{string.ascii_lowercase}', '{string.ascii_uppercase}')"
QUAL = "list_transform(range(length(seq)), lambda i: (read_id * 3 + i * 7) % 41)"
MEANQ = f"CASE WHEN length(seq) = 0 THEN 0 ELSE CAST(floor(list_sum({QUAL}) / length(seq)) AS INT) END"
GC = "CASE WHEN length(seq) = 0 THEN 0 ELSE CAST(floor(100 * (length(seq) - length(translate(seq, 'GCgc', ''))) / length(seq)) AS INT) END"
#: Short adapters that the fixture's reads do hold.
SHORT = ("ACGT", "GGTA", "TTTTT")
#: Reads that are sampled, and letters of a k-mer.
SAMPLE, K = 1_000_000, 7


def reads(s: SparkSession, d: str) -> DataFrame:
    """The reads of `fq` with qualities; its letters beyond the map are ASCII-folded nowhere, as in SQL."""
    quality = F.expr("case when length(seq) > 0 then transform(sequence(0, length(seq) - 1), i -> cast((read_id * 3 + i * 7) % 41 as int)) else cast(array() as array<int>) end")
    return load(s, d, X.FQ).select(F.lit(0).alias("file_idx"), F.col("read_id").alias("rec_no"), F.lit(1).alias("mate"), F.col("read_id").cast("string").alias("name"), "read_id", "seq", quality.alias("qual"))


FIRST = f"SELECT * FROM r ORDER BY read_id LIMIT {SAMPLE}"


@register("a1_fastq_summary", sql(f"SELECT count(*) AS total_reads, CAST(sum(length(seq)) AS BIGINT) AS total_bases, min(length(seq)) AS min_len, max(length(seq)) AS max_len, sum(length(seq)) / count(*) AS mean_len, count(*) FILTER (regexp_matches(seq, '[aA]{{12}}$')) AS poly_a, count(*) FILTER (regexp_matches(seq, '[gG]{{12}}$')) AS poly_g, count(*) FILTER (length(translate(seq, 'ACGTUacgtu', '')) > 0) AS n_reads FROM r", r=X.FQ))
def a1(s, d):
    return Q.summary(reads(s, d))


@register("a2_length_histogram", sql("SELECT length(seq) AS length, count(*) AS count FROM r GROUP BY 1", r=X.FQ))
def a2(s, d):
    return Q.length_histogram(reads(s, d))


@register("a2_gc_histogram", sql(f"SELECT {GC} AS gc, count(*) AS count FROM r GROUP BY 1", r=X.FQ))
def a2b(s, d):
    return Q.gc_histogram(reads(s, d))


@register("a2_quality_histogram", sql(f"SELECT {MEANQ} AS mean_quality, count(*) AS count FROM r GROUP BY 1", r=X.FQ))
def a2c(s, d):
    return Q.quality_histogram(reads(s, d))


KIND = "CASE WHEN b IN ('A', 'a') THEN 'A' WHEN b IN ('C', 'c') THEN 'C' WHEN b IN ('G', 'g') THEN 'G' WHEN b IN ('T', 't', 'U', 'u') THEN 'T' ELSE 'N' END"
BASES = "SELECT read_id, CAST(i AS INT) AS position, substr(seq, CAST(i + 1 AS INT), 1) AS b, (read_id * 3 + i * 7) % 41 AS q FROM (SELECT read_id, seq, unnest(range(length(seq))) AS i FROM r)"


@register("a3_per_position", sql(f"SELECT position, count(*) AS reads, CAST(sum(q) AS BIGINT) AS quality_sum, " + ", ".join(f"count(*) FILTER ({KIND} = '{b}') AS n_{b.lower()}" for b in "ACGTN") + " FROM x GROUP BY position", r=X.FQ, x=BASES))
def a3(s, d):
    return Q.per_position(reads(s, d))


@register("a3_position_qualities", sql("SELECT position, CAST(q AS INT) AS quality, count(*) AS count FROM x GROUP BY 1, 2", r=X.FQ, x=BASES))
def a3b(s, d):
    return Q.position_qualities(reads(s, d))


@register("a16_per_cycle", sql(f"SELECT CAST(1 + read_id % 2 AS INT) AS mate, position AS cycle, count(*) AS reads, CAST(sum(q) AS BIGINT) AS quality_sum, " + ", ".join(f"count(*) FILTER ({KIND} = '{b}') AS n_{b.lower()}" for b in "ACGTN") + " FROM x GROUP BY 1, 2", r=X.FQ, x=BASES))
def a16(s, d):
    from helixgrid.operators.alignment import per_cycle

    return per_cycle(reads(s, d).withColumn("flag", F.when(F.col("read_id") % 2 == 1, G.LAST).otherwise(G.FIRST)))


@register("a4_adapters", sql(f"SELECT adapter, CAST(instr({UP}, adapter) - 1 AS INT) AS position, count(*) AS count FROM r, (VALUES " + ", ".join(f"('{a}')" for a in SHORT) + f") v(adapter) WHERE instr({UP}, adapter) > 0 GROUP BY 1, 2", r=X.FQ))
def a4(s, d):
    return Q.adapters(reads(s, d), SHORT)


@register("w7_first_reads", sql("SELECT read_id, seq FROM s", r=X.FQ, s=FIRST))
def w7(s, d):
    return Q.sample(reads(s, d), SAMPLE).select("read_id", "seq")


@register("a5_duplication", sql("SELECT count(*) AS sampled, count(DISTINCT seq) AS distinct_reads, 1 - count(DISTINCT seq) / count(*) AS duplication FROM s", r=X.FQ, s=FIRST))
def a5(s, d):
    return Q.duplication(Q.sample(reads(s, d), SAMPLE))


@register("a6_overrepresented", sql("SELECT seq, count(*) AS count FROM r GROUP BY seq ORDER BY count DESC, seq LIMIT 20", r=X.FQ))
def a6(s, d):
    return Q.overrepresented(reads(s, d), 20)


def _kmers(k: int, source: str) -> str:
    return f"SELECT read_id, upper(substr(seq, CAST(i AS INT), {k})) AS kmer FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM {source} WHERE length(seq) >= {k}) WHERE regexp_full_match(substr(seq, CAST(i AS INT), {k}), '[ACGTacgt]+')"


@register("a6_kmer_counts", sql("SELECT kmer, count(*) AS count FROM x GROUP BY kmer", r=X.FQ, s=FIRST, x=_kmers(K, "s")))
def a6b(s, d):
    return Q.kmer_counts(Q.sample(reads(s, d), SAMPLE), K)


HIST = "SELECT length(seq) AS length, count(*) AS count FROM r GROUP BY 1"


@register("w3_nx", sql("SELECT CAST(x AS INT) AS x, max(length) AS length FROM (SELECT length, sum(length * count) OVER (ORDER BY length DESC) AS cum, sum(length * count) OVER () AS total FROM h WHERE length > 0), range(5, 101, 5) t(x) WHERE cum * 100 >= total * x GROUP BY x", r=X.FQ, h=HIST))
def w3(s, d):
    return Q.nx(Q.length_histogram(reads(s, d)))


@register("a9_length_bins", sql("SELECT bin_start, bin_start + 20 AS bin_end, reads, bases, CAST(sum(bases) OVER (ORDER BY bin_start DESC) AS BIGINT) AS cumulative_bases_ge_start FROM (SELECT length // 20 * 20 AS bin_start, CAST(sum(count) AS BIGINT) AS reads, CAST(sum(count * length) AS BIGINT) AS bases FROM h GROUP BY 1)", r=X.FQ, h=HIST))
def a9(s, d):
    return Q.length_bins(Q.length_histogram(reads(s, d)), 20)


@register("t1_top_lengths", sql("SELECT length, count FROM h ORDER BY count DESC, length LIMIT 10", r=X.FQ, h=HIST))
def t1(s, d):
    return Q.length_histogram(reads(s, d)).orderBy(F.desc("count"), "length").limit(10)


@register("p6_read_gc", sql(f"SELECT read_id, {GC} AS gc FROM r", r=X.FQ))
def p6(s, d):
    return reads(s, d).select("read_id", G.gc_percent("seq").alias("gc"))


@register("p7_read_quality", sql(f"SELECT read_id, {MEANQ} AS mean_quality FROM r", r=X.FQ))
def p7(s, d):
    return reads(s, d).select("read_id", G.mean_quality("qual").alias("mean_quality"))


@register("p8_base_class", sql(f"SELECT {KIND} AS kind, count(*) AS n FROM x GROUP BY 1", r=X.FQ, x=BASES))
def p8(s, d):
    return reads(s, d).select(F.explode(F.filter(F.split("seq", ""), lambda b: b != "")).alias("b")).groupBy(G.base_class("b").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@register("p9_poly_tail", sql("SELECT read_id, regexp_matches(seq, '[aA]{3}$') AS poly_a, regexp_matches(seq, '[gG]{3}$') AS poly_g FROM r", r=X.FQ))
def p9(s, d):
    return reads(s, d).select("read_id", G.poly_tail("seq", "A", 3).alias("poly_a"), G.poly_tail("seq", "G", 3).alias("poly_g"))


@register("p10_adapter_position", sql(f"SELECT read_id, CAST(instr({UP}, 'ACGT') - 1 AS INT) AS position FROM r", r=X.FQ))
def p10(s, d):
    return reads(s, d).select("read_id", G.adapter_start("seq", "ACGT").alias("position"))


@register("p11_kmers", sql("SELECT read_id, kmer, count(*) AS n FROM x GROUP BY 1, 2", r=X.FQ, x=_kmers(8, "r")))
def p11(s, d):
    return reads(s, d).select("read_id", F.explode(G.kmers("seq", 8)).alias("kmer")).groupBy("read_id", "kmer").agg(F.count(F.lit(1)).alias("n"))


@register("p12_reverse_complement", sql("SELECT kmer, translate(reverse(kmer), 'ACGT', 'TGCA') AS reversed FROM (SELECT DISTINCT kmer FROM x)", r=X.FQ, x=_kmers(6, "r")))
def p12(s, d):
    return reads(s, d).select(F.explode(G.kmers("seq", 6)).alias("kmer")).distinct().select("kmer", G.reverse_complement("kmer").alias("reversed"))


BENCH = X.FQ.replace("doc_id", "item_id").replace("{documents}", "{benchmark}")


@register("s13_reference_kmers", sql("SELECT DISTINCT kmer FROM (SELECT kmer FROM x UNION ALL SELECT translate(reverse(kmer), 'ACGT', 'TGCA') FROM x)", b=BENCH, x=_kmers(8, "b")))
def s13(s, d):
    return C.reference_kmers(load(s, d, BENCH), 8)


@register("j8_kmer_hits", sql("SELECT read_id, count(*) AS hits FROM x WHERE kmer IN (SELECT kmer FROM k UNION ALL SELECT translate(reverse(kmer), 'ACGT', 'TGCA') FROM k) GROUP BY read_id HAVING count(*) >= 2", r=X.FQ, x=_kmers(8, "r"), b=BENCH, k=_kmers(8, "b")))
def j8(s, d):
    return C.kmer_hits(reads(s, d), C.reference_kmers(load(s, d, BENCH), 8), 8, 2, ["read_id"])


CONV = "SELECT conv_id, turn, concat(CASE WHEN conv_id % 10 = 0 AND turn % 2 = 1 THEN 'x' ELSE 'c' END, CAST(conv_id AS STRING), '/', CAST(1 + turn % 2 AS STRING)) AS name, turn // 2 AS pair_no FROM conversations"


@register("j12_pair_names", sql("SELECT count(*) AS pairs, count(*) FILTER (regexp_replace(a.name, '(/2)*(/1)*$', '') <> regexp_replace(b.name, '(/2)*(/1)*$', '')) AS mismatches FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.pair_no = b.pair_no AND a.turn % 2 = 0 AND b.turn % 2 = 1", c=CONV))
def j12(s, d):
    name = F.concat(F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") % 2 == 1), "x").otherwise("c"), F.col("conv_id").cast("string"), F.lit("/"), (1 + F.col("turn") % 2).cast("string"))
    rows = s.read.parquet(f"{d}/conversations.parquet").select("turn", F.struct("conv_id", F.floor(F.col("turn") / 2).alias("pair_no")).alias("rec_no"), name.alias("name"))
    first, second = rows.filter("turn % 2 = 0"), rows.filter("turn % 2 = 1")
    return Q.name_mismatches(Q.pair(first.join(second.select("rec_no"), "rec_no", "left_semi"), second))


@register("p26_fractions", sql("SELECT read_id, coalesce((length(seq) - 40) / nullif(length(seq) - 150, 0), 0) AS fraction FROM r", r=X.FQ))
def p26(s, d):
    return reads(s, d).select("read_id", G.fraction(F.length("seq") - 40, F.length("seq") - 150).alias("fraction"))


@register("p24_hash_bucket", sql("SELECT read_id, CAST(CAST('0x' || substr(md5(CAST(read_id AS STRING)), 1, 8) AS BIGINT) % 100 AS INT) AS bucket FROM r".replace("STRING", "VARCHAR"), r=X.FQ))
def p24(s, d):
    return reads(s, d).select("read_id", G.hash_bucket("name").alias("bucket"))
