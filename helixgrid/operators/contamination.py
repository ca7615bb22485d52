"""Contamination screens. Records: flag, contig, pos0, mapq, cigar, seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators.intervals import merge_intervals, range_join


def primary(records: DataFrame) -> DataFrame:
    """Neither secondary nor supplementary; unmapped records stay."""
    return records.filter(~G.flag_is("flag", G.SECONDARY | G.SUPPLEMENTARY))


def to_screen(mode: str, mapq: int = 10) -> Column:
    """Which records k-mers are sought in: all, unmapped, or unmapped and low_mapq (a missing quality is screened)."""
    unmapped = G.flag_is("flag", G.UNMAPPED)
    return {"all": F.lit(True), "unmapped": unmapped, "low_mapq": unmapped | F.col("mapq").isNull() | (F.col("mapq") < mapq)}[mode]


def interval_hits(records: DataFrame, intervals: DataFrame, id_cols: list[str], bin_size: int) -> DataFrame:
    """The ids of records whose reference span overlaps an interval (chrom, start, end)."""
    merged = merge_intervals(intervals.withColumn("chrom", G.normalize_chrom("chrom"))).withColumnsRenamed({"start": "c_start", "end": "c_end"})
    spans = records.select(*id_cols, G.normalize_chrom("contig").alias("chrom"), F.col("pos0").alias("start"), (F.col("pos0") + G.reference_span("cigar")).alias("end"))
    return range_join(spans, merged, "chrom", ("start", "end"), ("c_start", "c_end"), bin_size, "left_semi").select(*id_cols).distinct()


def midpoint_hits(records: DataFrame, intervals: DataFrame, id_cols: list[str], bin_size: int) -> DataFrame:
    """The ids of records whose match midpoint lies in an interval."""
    merged = merge_intervals(intervals.withColumn("chrom", G.normalize_chrom("chrom"))).withColumnsRenamed({"start": "c_start", "end": "c_end"})
    span = G.match_span("cigar", "pos0")
    points = records.select(*id_cols, G.normalize_chrom("contig").alias("chrom"), span.alias("s")).filter("s is not null").select(*id_cols, "chrom", G.midpoint("s.start", "s.end").alias("start")).withColumn("end", F.col("start") + 1)
    return range_join(points, merged, "chrom", ("start", "end"), ("c_start", "c_end"), bin_size, "left_semi").select(*id_cols).distinct()


def reference_kmers(sequences: DataFrame, k: int, seq_col: str = "seq") -> DataFrame:
    """Distinct k-mers of both strands."""
    one = sequences.select(F.explode(G.kmers(seq_col, k)).alias("kmer"))
    return one.unionByName(one.select(G.reverse_complement("kmer").alias("kmer"))).distinct()


def fasta_kmers(spark: SparkSession, paths: str | list[str], k: int, window: int = 100_000) -> DataFrame:
    """reference_kmers() of FASTA files: windows reach k - 1 bases into the next one, so no k-mer is lost between them."""
    from helixgrid.sources import read_fasta

    return reference_kmers(read_fasta(spark, paths, window, k - 1), k)


def kmer_hits(reads: DataFrame, known: DataFrame, k: int, least: int, id_cols: list[str]) -> DataFrame:
    """ids and hits of reads with at least `least` occurrences of known k-mers."""
    found = reads.select(*id_cols, F.explode(G.kmers("seq", k)).alias("kmer")).join(known, "kmer", "left_semi")
    return found.groupBy(*id_cols).agg(F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= least)


def summary(records: DataFrame, hits: DataFrame, id_cols: list[str], rdna_contigs: tuple[str, ...] = ()) -> DataFrame:
    """Counts and fractions of one sample: mitochondrial contig, rDNA intervals, rDNA contigs, and rDNA by either.

    Only records with a contig can hit one, mapped or not.
    """
    p = primary(records).join(hits.withColumn("_hit", F.lit(True)), id_cols, "left")
    chrom = G.normalize_chrom("contig")
    by_interval, by_contig = F.coalesce("_hit", F.lit(False)), F.coalesce(chrom.isin(*[x.lower().removeprefix("chr") for x in rdna_contigs]), F.lit(False)) if rdna_contigs else F.lit(False)
    out = p.agg(F.count(F.lit(1)).alias("total"), F.count_if(chrom.isin(*G.CONTAM_MITO)).alias("mito"), F.count_if(by_interval).alias("rdna_interval"), F.count_if(by_contig).alias("rdna_contig"), F.count_if(by_interval | by_contig).alias("rdna"))
    return out.select("*", G.fraction("mito", "total").alias("mito_fraction"), G.fraction("rdna", "total").alias("rdna_fraction"))
