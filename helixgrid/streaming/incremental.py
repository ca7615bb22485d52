"""Additive metrics of files as they arrive: histograms are kept up to date by streaming aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from helixgrid.functions import genomics as G


def arriving(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files that are put into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def mapq_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("mapq", F.lit(255)).alias("mapq")).agg(F.count(F.lit(1)).alias("count"))


def contig_counts(records: DataFrame) -> DataFrame:
    mapped = ~G.flag_is("flag", G.UNMAPPED)
    return records.groupBy("contig").agg(F.count(F.lit(1)).alias("records"), F.count_if(mapped).alias("mapped"))


def run(metric: DataFrame, name: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the metric's full table in memory table `name`; state and progress are in the checkpoint folder."""
    writer = metric.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
