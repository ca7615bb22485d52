"""Queries over transcripts, genes and RNA reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators import annotation as N
from helixgrid.operators import profiles as P
from helixgrid.operators import rna as R
from helixgrid.operators.intervals import range_join
from helixgrid.plans import fixtures as X
from helixgrid.plans.alignment_queries import KEY, KEYS, REASON, aln, alnc
from helixgrid.plans.fixtures import load, sql
from helixgrid.plans.registry import register

CHROM = "regexp_replace(lower({0}), '^chr', '')"
#: Transcripts with what isoform choice looks at.
T = f"SELECT *, CASE WHEN tx_id % 5 = 0 THEN NULL ELSE e1s + 20 END AS cds_start, CASE WHEN tx_id % 5 = 0 THEN NULL ELSE e2e - 30 END AS cds_end, tx_id % 1100 = 7 AS mane_select, tx_id % 700 < 200 AS ensembl_canonical, CASE WHEN tx_id % 9 BETWEEN 1 AND 5 THEN CAST(tx_id % 9 AS INT) END AS appris, CASE WHEN tx_id % 6 > 0 THEN CAST(tx_id % 6 AS INT) END AS tsl, CASE WHEN tx_id % 4 = 0 THEN 'lncRNA' WHEN tx_id % 4 = 1 THEN NULL ELSE 'protein_coding' END AS biotype FROM ({X.TX}) z"


def transcripts(s: SparkSession, d: str) -> DataFrame:
    span = lambda a, b: F.struct(F.col(a).alias("start"), F.col(b).alias("end"))
    return load(s, d, T).withColumn("transcript_id", F.col("tx_id")).withColumn("exons", F.array(span("e1s", "e1e"), span("e2s", "e2e"))).drop("e1s", "e1e", "e2s", "e2e")


EX = """SELECT tx_id, gene_id, chrom, strand, cds_start, cds_end, 0 AS exon_no, e1s AS start, e1e AS "end", CASE WHEN strand = '-' THEN e2e - e2s ELSE 0 END AS "offset", e1e - e1s + e2e - e2s AS total_length FROM t
 UNION ALL SELECT tx_id, gene_id, chrom, strand, cds_start, cds_end, 1, e2s, e2e, CASE WHEN strand = '-' THEN 0 ELSE e1e - e1s END, e1e - e1s + e2e - e2s FROM t"""


@register("w9_exon_offsets", sql('SELECT tx_id, exon_no, start, "end", "offset", total_length FROM ex', t=T, ex=EX))
def w9(s, d):
    return N.spliced_offsets(N.exon_rows(transcripts(s, d))).select("tx_id", "exon_no", "start", "end", "offset", "total_length")


@register("p15_spliced_position", sql("SELECT tx_id, exon_no, \"offset\" + CASE WHEN strand = '-' THEN \"end\" - 1 - (start + 3) ELSE 3 END AS spliced FROM ex", t=T, ex=EX))
def p15(s, d):
    e = N.spliced_offsets(N.exon_rows(transcripts(s, d)))
    return e.select("tx_id", "exon_no", N.spliced_position(F.col("start") + 3).alias("spliced"))


#: A genomic range of each transcript, and the place in the middle of its spliced length.
CLIP = 'SELECT *, greatest(start, (tx_id * 101) % 4000 + 20) AS lo, least("end", (tx_id * 101) % 4000 + 370) AS hi FROM ex'


@register("p16_spliced_ranges", sql("SELECT tx_id, exon_no, s AS start_5p, s + hi - lo AS end_5p, total_length - s - (hi - lo) AS start_3p, total_length - s AS end_3p FROM (SELECT *, \"offset\" + CASE WHEN strand = '-' THEN \"end\" - hi ELSE lo - start END AS s FROM c WHERE lo < hi)", t=T, ex=EX, c=CLIP))
def p16(s, d):
    e = N.spliced_offsets(N.exon_rows(transcripts(s, d)))
    low = (F.col("tx_id") * 101) % 4000 + 20
    five, three = N.spliced_range(low, low + 350), N.spliced_range(low, low + 350, from_3p=True)
    return e.select("tx_id", "exon_no", five.alias("a"), three.alias("z")).filter("a is not null").select("tx_id", "exon_no", F.col("a.start").alias("start_5p"), F.col("a.end").alias("end_5p"), F.col("z.start").alias("start_3p"), F.col("z.end").alias("end_3p"))


@register("p16_genomic_position", sql("SELECT tx_id, CASE WHEN strand = '-' THEN \"end\" - 1 - (total_length // 2 - \"offset\") ELSE start + total_length // 2 - \"offset\" END AS pos FROM ex WHERE total_length // 2 >= \"offset\" AND total_length // 2 < \"offset\" + \"end\" - start", t=T, ex=EX))
def p16b(s, d):
    e = N.spliced_offsets(N.exon_rows(transcripts(s, d)))
    return e.select("tx_id", N.genomic_position(F.floor(F.col("total_length") / 2)).alias("pos")).filter("pos is not null")


ENDS = "SELECT *, e1e - e1s + e2e - e2s AS total_length, CASE WHEN strand = '-' THEN e2e ELSE e1s END AS five, CASE WHEN strand = '-' THEN e1s ELSE e2e END AS three FROM t"


@register("p17_transcript_ends", sql("SELECT tx_id, e1s AS tx_start, e2e AS tx_end, total_length, five AS five_prime_end, three AS three_prime_end FROM e", t=T, e=ENDS))
def p17(s, d):
    return N.with_ends(transcripts(s, d)).select("tx_id", "tx_start", "tx_end", "total_length", "five_prime_end", "three_prime_end")


@register("w10_introns", sql('SELECT tx_id, e1e AS start, e2s AS "end" FROM t', t=T))
def w10(s, d):
    return N.introns(N.exon_rows(transcripts(s, d))).select("tx_id", "start", "end")


@register("f8_biotype_filter", sql("SELECT tx_id FROM t WHERE lower(biotype) = 'protein_coding'", t=T))
def f8(s, d):
    wanted = F.array_contains(F.split(F.lower(F.lit("Protein_Coding,miRNA")), ","), F.lower("biotype"))
    return transcripts(s, d).filter(wanted).select("tx_id")


@register("f9_strand_filter", sql("SELECT tx_id FROM t WHERE strand = '+'", t=T))
def f9(s, d):
    return transcripts(s, d).filter("strand = '+'").select("tx_id")


@register("f10_min_length", sql("SELECT tx_id FROM e WHERE total_length >= 200", t=T, e=ENDS))
def f10(s, d):
    return N.with_ends(transcripts(s, d)).filter("total_length >= 200").select("tx_id")


NUM = "SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY total_length, tx_id) - 1 AS i, count(*) OVER (PARTITION BY gene_id) AS n, count(*) OVER (PARTITION BY gene_id, three) AS same3 FROM e"
_PICK = {
    "longest": "i DESC", "shortest": "i", "median": "CASE WHEN i = n // 2 THEN 0 ELSE 1 END",
    "canonical": "CASE WHEN mane_select THEN 0 ELSE 1 END, CASE WHEN ensembl_canonical THEN 0 ELSE 1 END, coalesce(appris, 9), coalesce(tsl, 9), CASE WHEN appris IS NULL AND tsl IS NULL AND i <> n // 2 THEN 1 ELSE 0 END, i",
    "common3p": "same3 DESC, CASE WHEN strand = '-' THEN -five ELSE five END, tx_id",
}


def _isoform(how: str, order: str) -> None:
    @register(f"a35_isoform_{how}", sql(f"SELECT gene_id, tx_id, total_length FROM u QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY {order}) = 1", t=T, e=ENDS, u=NUM))
    def query(s, d):
        return N.pick_isoforms(transcripts(s, d), how).select("gene_id", "tx_id", "total_length")


for _how, _order in _PICK.items():
    _isoform(_how, _order)


@register("a36_divergent_genes", sql("SELECT gene_id, max(three) - min(three) AS spread FROM e GROUP BY gene_id HAVING max(three) - min(three) > 3000", t=T, e=ENDS))
def a36(s, d):
    return N.divergent_genes(transcripts(s, d), 3000)


def _feature_sql() -> str:
    five, three = "'5''UTR_Exons'", "'3''UTR_Exons'"
    parts = [
        'SELECT chrom, \'CDS_Exons\' AS region, greatest(start, cds_start) AS start, least("end", cds_end) AS "end" FROM ex WHERE cds_start IS NOT NULL',
        f'SELECT chrom, CASE WHEN strand = \'+\' THEN {five} ELSE {three} END, start, least("end", cds_start) FROM ex WHERE cds_start IS NOT NULL',
        f'SELECT chrom, CASE WHEN strand = \'+\' THEN {three} ELSE {five} END, greatest(start, cds_end), "end" FROM ex WHERE cds_start IS NOT NULL',
        "SELECT chrom, 'Exons', start, \"end\" FROM ex WHERE cds_start IS NULL", "SELECT chrom, 'Introns', e1e, e2s FROM t",
    ]
    for near, far, name in N.FLANKS:
        parts += [
            f"SELECT chrom, 'TSS_up_{name}', CASE WHEN strand = '+' THEN greatest(five - {far}, 0) ELSE five + {near} END, CASE WHEN strand = '+' THEN greatest(five - {near}, 0) ELSE five + {far} END FROM e",
            f"SELECT chrom, 'TES_down_{name}', CASE WHEN strand = '+' THEN three + {near} ELSE greatest(three - {far}, 0) END, CASE WHEN strand = '+' THEN three + {far} ELSE greatest(three - {near}, 0) END FROM e",
        ]
    return " UNION ALL ".join(parts)


_Q = [r.replace("'", "''") for r in N.REGIONS]
FX = {
    "t": T, "ex": EX, "e": ENDS, "fe": f"SELECT regexp_replace(lower(chrom), '^chr', '') AS chrom, region, start, \"end\" FROM ({_feature_sql()}) WHERE start < \"end\"",
    "ev": "SELECT chrom, posn, " + ", ".join(f"sum(CASE WHEN region = '{r}' THEN d ELSE 0 END) AS d{i}" for i, r in enumerate(_Q)) + ' FROM (SELECT chrom, region, start AS posn, 1 AS d FROM fe UNION ALL SELECT chrom, region, "end", -1 FROM fe) GROUP BY chrom, posn',
    "sw": "SELECT chrom, posn AS start, lead(posn) OVER w AS \"end\", coalesce(" + ", ".join(f"CASE WHEN sum(d{i}) OVER (w ROWS UNBOUNDED PRECEDING) > 0 THEN '{r}' END" for i, r in enumerate(_Q)) + ") AS region FROM ev WINDOW w AS (PARTITION BY chrom ORDER BY posn)",
    "fi": """SELECT chrom, min(start) AS start, max("end") AS "end", region FROM (SELECT *, sum(fresh) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN lag(region) OVER w = region AND lag("end") OVER w = start THEN 0 ELSE 1 END AS fresh FROM sw WHERE "end" IS NOT NULL AND region IS NOT NULL WINDOW w AS (PARTITION BY chrom ORDER BY start))) GROUP BY chrom, island, region""",
}


def index(s: SparkSession, d: str) -> DataFrame:
    return N.feature_index(transcripts(s, d))


@register("w5_feature_index", sql("SELECT * FROM fi", **FX))
def w5(s, d):
    return index(s, d)


@register("a27_feature_sizes", sql('SELECT region, CAST(sum("end" - start) AS BIGINT) AS bases FROM fi GROUP BY region', **FX))
def a27(s, d):
    return N.feature_sizes(index(s, d))


RB = f'SELECT *, regexp_replace(lower(contig), \'^chr\', \'\') AS chrom FROM b'
LABEL = f"""SELECT {KEYS}, CASE WHEN bool_or(f.region IN ('CDS_Exons', '5''UTR_Exons', '3''UTR_Exons', 'Exons')) THEN 'Exons' WHEN bool_or(f.region = 'Introns') THEN 'Introns' WHEN bool_or(f.region IS NOT NULL) THEN 'TSS_up_1kb' ELSE 'Intergenic' END AS label
 FROM rb LEFT JOIN fi f ON f.chrom = rb.chrom AND f.start < rb."end" AND rb.start < f."end" WHERE rb.chrom IN (SELECT chrom FROM fi) GROUP BY {KEYS}"""


@register("j2_read_classes", sql("SELECT * FROM l", b=X.BLOCKS, rb=RB, **FX, l=LABEL))
def j2(s, d):
    return R.classify_reads(alnc(s, d), index(s, d), KEY, 512)


@register("a26_tag_counts", sql("SELECT label, count(*) AS tags FROM l GROUP BY label", b=X.BLOCKS, rb=RB, **FX, l=LABEL))
def a26(s, d):
    return R.classify_reads(alnc(s, d), index(s, d), KEY, 512).groupBy("label").agg(F.count(F.lit(1)).alias("tags"))


@register("j3_point_class", sql(f"SELECT {KEYS}, coalesce(region, 'Intergenic') AS region FROM a LEFT JOIN fi f ON f.chrom = regexp_replace(lower(contig), '^chr', '') AND f.start <= pos0 AND pos0 < f.\"end\"", a=X.ALN, **FX))
def j3(s, d):
    points = aln(s, d).select(*KEY, G.normalize_chrom("contig").alias("chrom"), F.col("pos0").alias("p0"), (F.col("pos0") + 1).alias("p1"))
    met = range_join(points, index(s, d).withColumnsRenamed({"start": "f0", "end": "f1"}), "chrom", ("p0", "p1"), ("f0", "f1"), 512)
    return points.join(met.select(*KEY, "region"), KEY, "left").select(*KEY, F.coalesce("region", F.lit("Intergenic")).alias("region"))


#: One transcript per gene, its exons and the bases that blocks lay on them, one row each.
ONE = "SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY gene_id ORDER BY i DESC) = 1"
GX = {"t": T, "e": ENDS, "u": NUM, "one": ONE, "ex": EX.replace("FROM t", "FROM one"), "b": X.BLOCKS, "pb": f"SELECT * FROM b WHERE {REASON} = 'passed'",
      # whole numbers instead of names within the expansion
      "xi": """SELECT CAST(substr(gene_id, 2) AS INT) AS gno, CAST(replace(substr(chrom, 4), 'M', '25') AS INT) AS cno, strand = '-' AS minus, start, "end", "offset", total_length FROM ex""",
      "bi": """SELECT CAST(replace(substr(contig, 4), 'M', '25') AS INT) AS cno, start, "end" FROM pb""",
      "hit": """SELECT gno, total_length, "offset" + CASE WHEN minus THEN x_end - 1 - p ELSE p - x_start END AS s5 FROM (
 SELECT gno, total_length, "offset", minus, xi.start AS x_start, xi."end" AS x_end, unnest(range(greatest(bi.start, xi.start), least(bi."end", xi."end"))) AS p FROM bi JOIN xi ON xi.cno = bi.cno AND bi.start < xi."end" AND xi.start < bi."end")""",
      "pc": "SELECT gno, CAST(100 * s5 // total_length AS BIGINT) AS bin, count(*) AS bases FROM hit GROUP BY 1, 2",
      # the 3' bins by arithmetic on runs of spliced positions
      "run": """SELECT gno, total_length - 1 - (a + hi - lo) AS t0, total_length - 1 - a AS t1 FROM (
 SELECT gno, total_length, greatest(bi.start, xi.start) AS lo, least(bi."end", xi."end") - 1 AS hi, "offset" + CASE WHEN minus THEN xi."end" - least(bi."end", xi."end") ELSE greatest(bi.start, xi.start) - xi.start END AS a FROM bi JOIN xi ON xi.cno = bi.cno AND bi.start < xi."end" AND xi.start < bi."end")""",
      "tp": "SELECT gno, CAST(k AS BIGINT) AS bin, CAST(sum(least(t1 + 1, k * 10 + 10) - greatest(t0, k * 10)) AS BIGINT) AS bases FROM run JOIN range(15) q(k) ON t0 < k * 10 + 10 AND t1 >= k * 10 GROUP BY 1, 2"}
PARAMS = P.ThreePrime(max_3p_dist=150, bin_size=10, normalization_bp=100, min_anchor_count=50, min_anchor_mean=10.0, min_anchor_nonzero_bins=3, max_ratio=1.5)


def bins(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    one = N.pick_isoforms(transcripts(s, d), "longest")
    exons = N.spliced_offsets(N.exon_rows(one.drop("total_length")))
    pct, three = R.gene_bins(R.read_blocks(R.passing(alnc(s, d)), []), exons, PARAMS.bin_size, PARAMS.max_3p_dist, 128)
    return one.select("gene_id", F.col("total_length").alias("gene_length")), pct, three


@register("a25_percentile_counts", sql("SELECT concat('G', CAST(gno AS VARCHAR)) AS gene_id, bin, bases FROM pc", **GX))
def a25(s, d):
    return bins(s, d)[1]


@register("j1_three_prime_counts", sql("SELECT concat('G', CAST(gno AS VARCHAR)) AS gene_id, bin, bases FROM tp", **GX))
def j1(s, d):
    return bins(s, d)[2]


TABLE = """SELECT *, CASE WHEN total < 2000 THEN 'low total support' WHEN gene_length < 100 THEN 'too short' WHEN anchor_sum < 50 THEN 'low anchor sum' WHEN anchor_mean < 10 THEN 'low anchor mean' WHEN anchor_nonzero_bins < 3 THEN 'low anchor nonzero bins' END AS skip_reason FROM (
 SELECT one.gene_id, CAST(substr(one.gene_id, 2) AS INT) AS gno, total_length AS gene_length, coalesce(total, 0) AS total, coalesce(anchor_sum, 0) AS anchor_sum, coalesce(nz, 0) AS anchor_nonzero_bins, coalesce(anchor_sum, 0) / 10.0 AS anchor_mean FROM one
 LEFT JOIN (SELECT gno, CAST(sum(bases) AS BIGINT) AS total FROM pc GROUP BY 1) a ON a.gno = CAST(substr(one.gene_id, 2) AS INT) LEFT JOIN (SELECT gno, CAST(sum(bases) AS BIGINT) AS anchor_sum, count(*) AS nz FROM tp WHERE bin < 10 GROUP BY 1) c ON c.gno = CAST(substr(one.gene_id, 2) AS INT))"""


def table(s: SparkSession, d: str, floor: bool = False):
    genes, pct, three = bins(s, d)
    return P.gene_table(genes, pct, three, 2000, PARAMS, floor), pct, three, genes


@register("f14_gene_acceptance", sql("SELECT gene_id, gene_length, total, anchor_sum, anchor_nonzero_bins, anchor_mean, skip_reason FROM tab", **GX, tab=TABLE))
def f14(s, d):
    return table(s, d)[0].select("gene_id", "gene_length", "total", "anchor_sum", "anchor_nonzero_bins", "anchor_mean", "skip_reason")


@register("f13_gene_support", sql("SELECT gene_id, total FROM tab WHERE total >= 2000 AND gene_length >= 100", **GX, tab=TABLE))
def f13(s, d):
    return table(s, d)[0].filter("total >= 2000 and gene_length >= 100").select("gene_id", "total")


@register("a28_three_prime_profile", sql("""SELECT CAST(bin AS INT) AS bin, count(*) FILTER (used) AS support, coalesce(sum(ratio) FILTER (used), 0) AS ratio_sum, CAST(sum(CASE WHEN used THEN bases ELSE 0 END) AS BIGINT) AS raw_analyzed, CAST(sum(bases) AS BIGINT) AS raw_all, coalesce(avg(ratio) FILTER (used), 0) AS mean
 FROM (SELECT g.bin, skip_reason IS NULL AS used, coalesce(bases, 0) AS bases, least(coalesce(bases, 0) / nullif(anchor_mean, 0), 1.5) AS ratio FROM (SELECT *, unnest(range(least(CAST(ceil(gene_length / 10) AS INT), 15))) AS bin FROM tab) g LEFT JOIN tp ON tp.gno = g.gno AND tp.bin = g.bin) GROUP BY bin""", **GX, tab=TABLE))
def a28(s, d):
    t, _, three, _ = table(s, d)
    return P.three_prime_profile(t, three, PARAMS)


def _body(group: str, weight: str, least: int) -> str:
    return f"""SELECT k.class, CAST(k.bin AS INT) AS bin, coalesce(s, 0) / w AS mean, coalesce(coalesce(s, 0) / w * 100 / nullif(max(coalesce(s, 0) / w) OVER (PARTITION BY k.class), 0), 0) AS percent FROM (SELECT class, w, unnest(range(100)) AS bin FROM (SELECT {group} AS class, CAST(sum({weight}) AS DOUBLE) AS w FROM tab WHERE total >= 2000 AND gene_length >= {least} GROUP BY 1)) k
 LEFT JOIN (SELECT {group} AS class, bin, sum({weight} * bases / (total / 100)) AS s FROM pc JOIN tab ON tab.gno = pc.gno WHERE total >= 2000 AND gene_length >= {least} GROUP BY 1, 2) x ON x.class = k.class AND x.bin = k.bin"""


@register("a29_gene_body", sql(_body("'all'", "1.0", 100), **GX, tab=TABLE))
def a29(s, d):
    genes, pct, _ = bins(s, d)
    return P.gene_body(genes, pct, 2000)


@register("a29_gene_body_weighted", sql(_body("'all'", "least(CAST(total AS DOUBLE), 40000.0)", 100), **GX, tab=TABLE))
def a29b(s, d):
    genes, pct, _ = bins(s, d)
    return P.gene_body(genes, pct, 2000, weighted=True)


@register("a30_stratified_gene_body", sql(_body("CASE WHEN gene_length >= 10001 THEN 'very long (>10kb)' WHEN gene_length >= 5001 THEN 'long (5-10kb)' WHEN gene_length >= 1500 THEN 'medium (1.5-5kb)' ELSE 'short (<1.5kb)' END", "1.0", 0), **GX, tab=TABLE.replace("total_length AS gene_length", "total_length * (1 + CAST(substr(one.gene_id, 2) AS INT) % 60) AS gene_length")))
def a30(s, d):
    genes, pct, _ = bins(s, d)
    longer = genes.withColumn("gene_length", F.col("gene_length") * (1 + F.substr("gene_id", F.lit(2)).cast("int") % 60))
    return P.stratified_gene_body(longer, pct, 2000)


@register("a31_stratified_three_prime", sql("""SELECT stratum, CAST(bin AS INT) AS bin, count(*) FILTER (used) AS support, coalesce(sum(ratio) FILTER (used), 0) AS ratio_sum, CAST(sum(CASE WHEN used THEN bases ELSE 0 END) AS BIGINT) AS raw_analyzed, CAST(sum(bases) AS BIGINT) AS raw_all, coalesce(avg(ratio) FILTER (used), 0) AS mean
 FROM (SELECT g.stratum, g.bin, skip_reason IS NULL AS used, coalesce(bases, 0) AS bases, least(coalesce(bases, 0) / nullif(anchor_mean, 0), 1.5) AS ratio FROM (SELECT *, CASE WHEN gene_length < 2000 THEN 'all' WHEN gene_length < 5000 THEN '2-5kb' WHEN gene_length < 10000 THEN '5-10kb' WHEN gene_length < 20000 THEN '10-20kb' ELSE '20kb+' END AS stratum, unnest(range(least(CAST(ceil(gene_length / 10) AS INT), 15))) AS bin FROM tab) g LEFT JOIN tp ON tp.gno = g.gno AND tp.bin = g.bin) WHERE stratum <> 'all' GROUP BY 1, 2""", **GX, tab=TABLE.replace("total_length AS gene_length", "total_length * (1 + CAST(substr(one.gene_id, 2) AS INT) % 60) AS gene_length")))
def a31(s, d):
    genes, pct, three = bins(s, d)
    longer = genes.withColumn("gene_length", F.col("gene_length") * (1 + F.substr("gene_id", F.lit(2)).cast("int") % 60))
    return P.stratified_three_prime(longer, pct, three, 2000, PARAMS)


@register("p25_length_strata", sql("SELECT gene_id, CASE WHEN n < 2000 THEN 'all' WHEN n < 5000 THEN '2-5kb' WHEN n < 10000 THEN '5-10kb' WHEN n < 20000 THEN '10-20kb' ELSE '20kb+' END AS stratum FROM (SELECT gene_id, total_length * (1 + CAST(substr(gene_id, 2) AS INT) % 100) AS n FROM one)", **{k: GX[k] for k in ("t", "e", "u", "one")}))
def p25(s, d):
    one = N.pick_isoforms(transcripts(s, d), "longest")
    return one.select("gene_id", G.length_stratum(F.col("total_length") * (1 + F.substr("gene_id", F.lit(2)).cast("int") % 100)).alias("stratum"))


JN = f"SELECT regexp_replace(lower(contig), '^chr', '') AS chrom, pos0 + 10 AS start, pos0 + 110 AS \"end\", CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand, count(*) AS reads FROM a WHERE l_linenumber % 4 = 2 AND {REASON} = 'passed' GROUP BY 1, 2, 3, 4"
#: Annotated introns that some reads do share.
KNOWN = "SELECT DISTINCT regexp_replace(lower(contig), '^chr', '') AS chrom, pos0 + 10 AS start, pos0 + 110 + CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE 0 END AS \"end\" FROM a WHERE l_linenumber % 4 = 2 AND l_quantity > 40"
NOVEL = """SELECT j.*, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.chrom = j.chrom AND k.start = j.start AND k."end" = j."end") THEN 'Known' WHEN EXISTS (SELECT 1 FROM k WHERE k.chrom = j.chrom AND k.start = j.start) OR EXISTS (SELECT 1 FROM k WHERE k.chrom = j.chrom AND k."end" = j."end") THEN 'PartialNovel' ELSE 'Novel' END AS novelty FROM j"""


def classified(s, d):
    known = alnc(s, d).filter("l_linenumber % 4 = 2 and l_quantity > 40").select(F.col("contig").alias("chrom"), (F.col("pos0") + 10).alias("start"), (F.col("pos0") + 110 + F.when(F.col("l_suppkey") % 3 == 0, 7).otherwise(0)).alias("end"))
    return R.classify_junctions(R.junctions(R.passing(alnc(s, d))), known)


@register("a33_junctions", sql("SELECT * FROM j", a=X.ALNC, j=JN))
def a33(s, d):
    return R.junctions(R.passing(alnc(s, d))).drop("min_bucket")


@register("j13_junction_novelty", sql("SELECT * FROM n", a=X.ALNC, j=JN, k=KNOWN, n=NOVEL))
def j13(s, d):
    return classified(s, d).drop("min_bucket")


@register("a33_junction_metrics", sql("SELECT novelty, count(*) AS junctions, CAST(sum(reads) AS BIGINT) AS reads FROM n GROUP BY novelty", a=X.ALNC, j=JN, k=KNOWN, n=NOVEL))
def a33b(s, d):
    return R.junction_metrics(classified(s, d))


#: The least name bucket of each junction and strand.
BUCKETS = f"SELECT regexp_replace(lower(contig), '^chr', '') AS chrom, pos0 + 10 AS start, pos0 + 110 AS \"end\", (flag & 16) <> 0 AS minus, min(CAST('0x' || substr(md5(qname), 1, 8) AS BIGINT) % 100) AS bucket FROM a WHERE l_linenumber % 4 = 2 AND {REASON} = 'passed' GROUP BY 1, 2, 3, 4"


@register("a34_junction_saturation", sql("""SELECT novelty, CAST(percent AS INT) AS percent, count(*) FILTER (bucket < percent) AS junctions FROM (SELECT n.novelty, h.bucket FROM n JOIN h ON h.chrom = n.chrom AND h.start = n.start AND h."end" = n."end" AND h.minus = (n.strand = '-')), range(10, 101, 10) p(percent) GROUP BY 1, 2""", a=X.ALNC, j=JN, k=KNOWN, n=NOVEL, h=BUCKETS))
def a34(s, d):
    return R.junction_saturation(classified(s, d))


ORD = f"SELECT *, (row_number() OVER (PARTITION BY qname ORDER BY {KEYS}) - 1) // 2 AS pno, (row_number() OVER (PARTITION BY qname ORDER BY {KEYS}) - 1) % 2 AS side FROM a WHERE {REASON} = 'passed'"
PAIR = "SELECT x.qname, x.pno, CASE WHEN (x.flag & 64) <> 0 THEN x ELSE y END AS r1, CASE WHEN (x.flag & 64) <> 0 THEN y ELSE x END AS r2 FROM o x JOIN o y ON x.qname = y.qname AND x.pno = y.pno AND x.side = 0 AND y.side = 1 WHERE ((x.flag & 64) <> 0) <> ((y.flag & 64) <> 0)"


@register("j10_mate_pairs", sql("SELECT qname, r1.pos0 AS pos1, r2.pos0 AS pos2, r1.contig AS contig1, r2.contig AS contig2 FROM pr", a=X.ALN, o=ORD, pr=PAIR))
def j10(s, d):
    p = R.mate_pairs(R.passing(aln(s, d)), KEY)
    return p.select("qname", F.col("r1.pos0").alias("pos1"), F.col("r2.pos0").alias("pos2"), F.col("r1.contig").alias("contig1"), F.col("r2.contig").alias("contig2"))


@register("t5_first_pairs", sql("SELECT qname, pno AS pair_no FROM pr ORDER BY qname, pno LIMIT 1000000", a=X.ALN, o=ORD, pr=PAIR))
def t5(s, d):
    return R.first_pairs(R.mate_pairs(R.passing(aln(s, d)), KEY), 1_000_000, ["qname", "pair_no"]).select("qname", "pair_no")


#: Mates on one gene are rare in the fixture, so names are those of a window of a contig.
NEAR = f"SELECT * REPLACE (concat(contig, ':', CAST(pos0 // 40 AS STRING)) AS qname) FROM ({X.ALNC}) q"
ID = {"t": T, "e": ENDS, "u": NUM, "one": ONE, "ex": EX.replace("FROM t", "FROM one"), "a": NEAR, "o": ORD, "pr": PAIR,
      "side": """SELECT qname, pno, side, r.contig AS contig, r.pos0 AS s, r.pos0 + CASE WHEN r.l_linenumber % 4 = 2 THEN r.mlen + 100 WHEN r.l_linenumber % 4 = 3 THEN r.mlen + 3 ELSE r.mlen END AS z, CASE WHEN r.l_linenumber % 4 = 3 THEN r.mlen + 3 ELSE r.mlen END AS aligned, (r.flag & 16) <> 0 AS rev
 FROM (SELECT qname, pno, 1 AS side, r1 AS r FROM pr UNION ALL SELECT qname, pno, 2, r2 FROM pr)""",
      "hitg": 'SELECT qname, pno, side, min(gene_id) AS gene_id, min(strand) AS strand FROM side JOIN ex ON ex.chrom = side.contig AND s + (z - s) // 2 >= ex.start AND s + (z - s) // 2 < ex."end" GROUP BY 1, 2, 3 HAVING count(DISTINCT strand) = 1',
      "bothg": "SELECT x.qname, x.pno, hx.gene_id, hx.strand, least(x.s, y.s) AS p1, greatest(x.z, y.z) - 1 AS p2, x.aligned + y.aligned AS aligned, x.rev AS rev1, y.rev AS rev2 FROM side x JOIN side y ON x.qname = y.qname AND x.pno = y.pno AND x.side = 1 AND y.side = 2 AND x.contig = y.contig JOIN hitg hx ON hx.qname = x.qname AND hx.pno = x.pno AND hx.side = 1 JOIN hitg hy ON hy.qname = x.qname AND hy.pno = x.pno AND hy.side = 2 AND hy.gene_id = hx.gene_id",
      "dist": """SELECT abs(s1 - s2) + 1 - aligned AS inner_distance, rev1 AS r1_reverse, rev2 AS r2_reverse, strand AS gene_strand FROM (SELECT b.*, a1."offset" + CASE WHEN a1.strand = '-' THEN a1."end" - 1 - p1 ELSE p1 - a1.start END AS s1, a2."offset" + CASE WHEN a2.strand = '-' THEN a2."end" - 1 - p2 ELSE p2 - a2.start END AS s2
 FROM bothg b JOIN ex a1 ON a1.gene_id = b.gene_id AND p1 >= a1.start AND p1 < a1."end" JOIN ex a2 ON a2.gene_id = b.gene_id AND p2 >= a2.start AND p2 < a2."end") WHERE abs(s1 - s2) + 1 - aligned BETWEEN -1000 AND 2000"""}


def distances(s, d):
    near = alnc(s, d).withColumn("qname", F.concat("contig", F.lit(":"), F.floor(F.col("pos0") / 40).cast("string")))
    one = N.pick_isoforms(transcripts(s, d), "longest")
    return R.inner_distances(R.mate_pairs(R.passing(near), KEY), N.spliced_offsets(N.exon_rows(one.drop("total_length"))))


@register("j11_inner_distances", sql("SELECT * FROM dist", **ID))
def j11(s, d):
    return distances(s, d)


@register("a32_pair_summary", sql("""SELECT *, CASE WHEN stranded_forward + stranded_reverse < 100 THEN CASE WHEN pairs = 0 THEN 'undetermined' WHEN fr / pairs >= 0.8 THEN 'FR (geom)' WHEN rf / pairs >= 0.8 THEN 'RF (geom)' ELSE 'mixed (geom)' END
 WHEN stranded_forward / (stranded_forward + stranded_reverse) >= 0.8 THEN 'FR (stranded-forward)' WHEN stranded_reverse / (stranded_forward + stranded_reverse) >= 0.8 THEN 'RF (stranded-reverse)' ELSE 'unstranded/mixed' END AS label
 FROM (SELECT count(*) AS pairs, count(*) FILTER (NOT r1_reverse AND r2_reverse) AS fr, count(*) FILTER (r1_reverse AND NOT r2_reverse) AS rf, count(*) FILTER (r1_reverse = r2_reverse) AS other, count(*) FILTER (r1_reverse <> (gene_strand = '+')) AS stranded_forward, count(*) FILTER (r1_reverse = (gene_strand = '+')) AS stranded_reverse, avg(inner_distance) AS mean_distance, median(inner_distance) AS median_distance FROM dist)""", **ID))
def a32(s, d):
    return R.pair_summary(distances(s, d))


@register("f15_distance_range", sql("SELECT inner_distance, count(*) AS n FROM dist WHERE inner_distance BETWEEN -200 AND 200 GROUP BY 1", **ID))
def f15(s, d):
    return distances(s, d).filter("inner_distance between -200 and 200").groupBy("inner_distance").agg(F.count(F.lit(1)).alias("n"))


@register("a24_rna_counters", sql(f"SELECT count(*) AS reads, count(*) FILTER (contig = 'chrM') AS mito FROM a WHERE {REASON} = 'passed'", a=X.ALN))
def a24(s, d):
    return R.mito_counts(R.passing(aln(s, d)))


RDNA = f"SELECT contig, regexp_replace(lower(contig), '^chr', '') IN ('3', '9') OR EXISTS (SELECT 1 FROM c WHERE c.chrom = q.contig AND c.start <= mid AND mid < c.\"end\") AS hit FROM (SELECT *, pos0 + CASE WHEN l_linenumber % 4 = 2 THEN mlen + 100 WHEN l_linenumber % 4 = 3 THEN mlen + 3 ELSE mlen END // 2 AS mid FROM a WHERE {REASON} = 'passed') q"


@register("a24_ribosomal_counters", sql("SELECT count(*) AS aligned_qc_reads, count(*) FILTER (contig = 'chrM') AS mtdna_reads, count(*) FILTER (hit) AS rdna_reads FROM r", a=X.ALNC, c=X.CONTAM, r=RDNA))
def a24b(s, d):
    return R.counters(R.passing(alnc(s, d)), load(s, d, X.CONTAM), KEY, ("chr3", "CHR9"), 256)


@register("a39_merge_counts", sql(f"SELECT {REASON} AS reason, CAST(2 * count(*) AS BIGINT) AS count FROM a GROUP BY 1", a=X.ALN))
def a39(s, d):
    one = R.filter_counts(aln(s, d))
    return R.merge_counts([one, one], ["reason"])
