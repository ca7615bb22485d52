"""BED targets, contaminant intervals and marker tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tab_rows(lines: DataFrame, least: int) -> DataFrame:
    """f (array of fields) of lines (value) that are neither empty nor comments, track or browser lines."""
    lines = lines.filter(~F.col("value").rlike(r"^\s*(#|$|track\b|browser\b)"))
    return lines.select(F.split(F.rtrim("value"), "\t").alias("f")).filter(F.size("f") >= least)


def _field(i: int):
    return F.get(F.col("f"), F.lit(i))


def read_bed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, start, end; empty intervals are dropped."""
    rows = tab_rows(spark.read.text(path), 3).select(_field(0).alias("chrom"), _field(1).cast("long").alias("start"), _field(2).cast("long").alias("end"))
    return rows.filter("start < end")


def read_targets(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """contig, start, end, name; without a name it is chrom:start-end."""
    return targets(spark.read.text(path))


def targets(lines: DataFrame) -> DataFrame:
    """What read_targets gives, of lines (value)."""
    rows = tab_rows(lines, 3).select(_field(0).alias("contig"), _field(1).cast("long").alias("start"), _field(2).cast("long").alias("end"), _field(3).alias("name"))
    named = F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(F.concat("contig", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    return rows.filter("start < end").withColumn("name", named)


def read_markers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """chrom, pos, label, marker_type, end_pos (null if absent). A header line has no number in its second field and is left out."""
    rows = tab_rows(spark.read.text(path), 2).select(_field(0).alias("chrom"), _field(1).try_cast("long").alias("pos"), _field(2).alias("label"), F.coalesce(_field(3), F.lit("variant")).alias("marker_type"), _field(4).try_cast("long").alias("end_pos"))
    return rows.filter("pos is not null")
