"""Transcripts from GTF and BED12.

Columns: transcript_id, gene_id, gene_name, biotype, chrom, strand, exons (array of start, end; by start), cds_start,
cds_end, mane_select, ensembl_canonical, appris, tsl, strategy (where gene_id comes from). 0-based and half-open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.functions.genomics import appris_level, gtf_attribute, support_level
from helixgrid.sources.intervals import tab_rows


def read_gtf(spark: SparkSession, path: str | list[str], biotypes: str | None = None, plus_only: bool = False) -> DataFrame:
    """exon and CDS lines, grouped by transcript. Tags are sought in all attributes of all lines of a transcript; gzip by suffix."""
    f = lambda i: F.get(F.col("f"), F.lit(i))
    lines = tab_rows(spark.read.text(path), 9).filter(f(2).isin("exon", "CDS")).select(f(0).alias("chrom"), f(2).alias("feature"), (f(3).cast("long") - 1).alias("start"), f(4).cast("long").alias("end"), f(6).alias("strand"), f(8).alias("attr"))
    biotype = F.coalesce(*[gtf_attribute("attr", k) for k in ("transcript_biotype", "transcript_type", "gene_biotype", "gene_type")])
    rows = lines.select("*", gtf_attribute("attr", "transcript_id").alias("transcript_id"), F.coalesce(gtf_attribute("attr", "gene_id"), gtf_attribute("attr", "gene")).alias("gene_id"), gtf_attribute("attr", "gene_name").alias("gene_name"), biotype.alias("biotype")).filter("transcript_id is not null")
    if plus_only:
        rows = rows.filter("strand = '+'")
    if biotypes:
        rows = rows.filter(F.lower("biotype").isin(*[b.strip().lower() for b in biotypes.split(",")]))
    exon = F.struct("start", "end")
    low = F.lower("attr")
    grouped = rows.groupBy("transcript_id").agg(
        F.first("gene_id", True).alias("gene_id"), F.first("gene_name", True).alias("gene_name"), F.first("biotype", True).alias("biotype"), F.min("chrom").alias("chrom"), F.min("strand").alias("strand"),
        F.sort_array(F.collect_list(F.when(F.col("feature") == "exon", exon))).alias("exons"),
        F.min(F.when(F.col("feature") == "CDS", F.col("start"))).alias("cds_start"), F.max(F.when(F.col("feature") == "CDS", F.col("end"))).alias("cds_end"),
        F.bool_or(low.contains("mane_select")).alias("mane_select"), F.bool_or(low.contains("ensembl_canonical")).alias("ensembl_canonical"), F.min(appris_level("attr")).alias("appris"), F.min(support_level("attr")).alias("tsl"),
    )
    known = grouped.filter(F.size("exons") > 0)
    return known.withColumn("strategy", F.when(F.col("gene_id").isNull(), "transcript_id").otherwise("gene_id")).withColumn("gene_id", F.coalesce("gene_id", "transcript_id"))


def read_bed12(spark: SparkSession, path: str | list[str], gene_id_regex: str | None = None, gene_id_delimiter: str | None = None, plus_only: bool = False) -> DataFrame:
    """Blocks are exons, the thick part is coding if it isn't empty. The gene id is the regex's first group of the name, else what stands before the delimiter, else the name. No biotype: filters on it let BED12 pass."""
    f = lambda i: F.get(F.col("f"), F.lit(i))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    rows = tab_rows(spark.read.text(path), 12).select(f(0).alias("chrom"), f(1).cast("long").alias("at"), f(3).alias("name"), f(5).alias("strand"), f(6).cast("long").alias("t0"), f(7).cast("long").alias("t1"), numbers(f(10)).alias("sizes"), numbers(f(11)).alias("starts"))
    exons = F.sort_array(F.transform(F.arrays_zip("sizes", "starts"), lambda x: F.struct((F.col("at") + x["starts"]).alias("start"), (F.col("at") + x["starts"] + x["sizes"]).alias("end"))))
    gene, how = F.col("name"), F.lit("name")
    if gene_id_delimiter:
        head = F.substring_index("name", gene_id_delimiter, 1)
        gene, how = F.when(F.contains("name", F.lit(gene_id_delimiter)), head).otherwise(gene), F.when(F.contains("name", F.lit(gene_id_delimiter)), "delimiter").otherwise(how)
    if gene_id_regex:
        got = F.regexp_extract("name", gene_id_regex, 1)
        gene, how = F.when(got != "", got).otherwise(gene), F.when(got != "", "regex").otherwise(how)
    coding = F.col("t0") < F.col("t1")
    none = lambda kind: F.lit(None).cast(kind)
    out = rows.select(F.col("name").alias("transcript_id"), gene.alias("gene_id"), none("string").alias("gene_name"), none("string").alias("biotype"), "chrom", "strand", exons.alias("exons"), F.when(coding, F.col("t0")).alias("cds_start"), F.when(coding, F.col("t1")).alias("cds_end"), F.lit(False).alias("mane_select"), F.lit(False).alias("ensembl_canonical"), none("int").alias("appris"), none("int").alias("tsl"), how.alias("strategy"))
    return out.filter("strand = '+'") if plus_only else out


def load_annotation(spark: SparkSession, path: str, **how) -> DataFrame:
    """By suffix: .gtf, .gff or .bed, each also with .gz; a Parquet folder is an annotation that was saved."""
    name = path.lower().removesuffix(".gz").rstrip("/")
    if name.endswith((".gtf", ".gff", ".gff3")):
        return read_gtf(spark, path, **how)
    if name.endswith((".bed", ".bed12")):
        return read_bed12(spark, path, **how)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"cannot tell the annotation format of {path}")


def genes_in_region(transcripts: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Transcripts that overlap a region, their distinct exons clipped to it."""
    span = transcripts.filter((F.regexp_replace("chrom", "^chr", "") == chrom.removeprefix("chr")) & (F.array_max(F.transform("exons", lambda e: e["end"])) > start) & (F.array_min(F.transform("exons", lambda e: e["start"])) < end))
    clipped = F.filter(F.transform("exons", lambda e: F.struct(F.greatest(e["start"], F.lit(start)).alias("start"), F.least(e["end"], F.lit(end)).alias("end"))), lambda e: e["start"] < e["end"])
    return span.withColumn("exons", F.array_sort(F.array_distinct(clipped)))


def find_gene(transcripts: DataFrame, name: str) -> DataFrame:
    """chrom, start, end of the longest gene of that name or id, in any case."""
    hit = transcripts.filter((F.lower("gene_name") == name.lower()) | (F.lower("gene_id") == name.lower()))
    spans = hit.groupBy("gene_id", "chrom").agg(F.min(F.array_min(F.transform("exons", lambda e: e["start"]))).alias("start"), F.max(F.array_max(F.transform("exons", lambda e: e["end"]))).alias("end"))
    return spans.orderBy(F.desc(F.col("end") - F.col("start")), "gene_id").limit(1)
