"""Gene body and 3' profiles. percentiles, three_prime: gene_id, bin, bases; genes: gene_id, gene_length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.functions.genomics import length_class, length_stratum


@dataclass(frozen=True)
class ThreePrime:
    max_3p_dist: int = 3_000
    bin_size: int = 10
    normalization_bp: int = 200
    min_anchor_count: int = 10
    min_anchor_mean: float = 0.5
    min_anchor_nonzero_bins: int = 3
    max_ratio: float = 5.0

    @property
    def bins(self) -> int:
        return -(-self.max_3p_dist // self.bin_size)


def gene_table(genes: DataFrame, percentiles: DataFrame, three_prime: DataFrame, min_support: int, p: ThreePrime, floor_anchor: bool = False) -> DataFrame:
    """Per gene: total, anchor sum, mean and non-zero bins, and skip_reason (null if used; the first test that fails)."""
    anchor_bins = p.normalization_bp // p.bin_size if floor_anchor else -(-p.normalization_bp // p.bin_size)
    divisor = max(1, anchor_bins if floor_anchor else min(anchor_bins, p.bins))
    total = percentiles.groupBy("gene_id").agg(F.sum("bases").alias("total"))
    anchor = three_prime.filter(F.col("bin") < divisor).groupBy("gene_id").agg(F.sum("bases").alias("anchor_sum"), F.count_if(F.col("bases") > 0).alias("anchor_nonzero_bins"))
    t = genes.join(total, "gene_id", "left").join(anchor, "gene_id", "left").na.fill(0, ["total", "anchor_sum", "anchor_nonzero_bins"]).withColumn("anchor_mean", F.col("anchor_sum") / divisor)
    reason = F.when(F.col("total") < min_support, "low total support").when(F.col("gene_length") < p.normalization_bp, "too short").when(F.col("anchor_sum") < p.min_anchor_count, "low anchor sum").when(F.col("anchor_mean") < p.min_anchor_mean, "low anchor mean").when(F.col("anchor_nonzero_bins") < p.min_anchor_nonzero_bins, "low anchor nonzero bins")
    return t.withColumn("skip_reason", reason)


def three_prime_profile(table: DataFrame, three_prime: DataFrame, p: ThreePrime, by: list[str] | None = None) -> DataFrame:
    """bin, support, ratio_sum (clipped), mean, raw_analyzed, raw_all; bins up to the longest gene."""
    by = by or []
    reach = F.least(F.ceil(F.col("gene_length") / p.bin_size), F.lit(p.bins)).cast("int")
    every = table.withColumn("bin", F.explode(F.sequence(F.lit(0), F.greatest(reach - 1, F.lit(0))))).filter("gene_length > 0")
    x = every.join(three_prime.select("gene_id", F.col("bin").cast("int").alias("bin"), "bases"), ["gene_id", "bin"], "left").na.fill(0, ["bases"])
    used = F.col("skip_reason").isNull()
    ratio = F.least(F.try_divide("bases", "anchor_mean"), F.lit(p.max_ratio))
    out = x.groupBy(*by, "bin").agg(F.count_if(used).alias("support"), F.coalesce(F.sum(F.when(used, ratio)), F.lit(0.0)).alias("ratio_sum"), F.sum(F.when(used, F.col("bases")).otherwise(0)).alias("raw_analyzed"), F.sum("bases").alias("raw_all"))
    return out.withColumn("mean", F.when(F.col("support") > 0, F.col("ratio_sum") / F.col("support")).otherwise(0.0))


def gene_body(genes: DataFrame, percentiles: DataFrame, min_support: int, weighted: bool = False, by: Column | None = None, min_length: int = 100) -> DataFrame:
    """bin (0..99), mean and percent of the peak of per-gene profiles whose own mean is 1; by classes if `by` is given.

    A gene weighs 1, or its bases up to 20 times min_support (2,000 at least). Genes without bases are left out.
    """
    cap = max(min_support * 20.0, 2_000.0)
    total = percentiles.groupBy("gene_id").agg(F.sum("bases").alias("total")).filter((F.col("total") >= min_support) & (F.col("total") > 0))
    g = genes.filter(F.col("gene_length") >= min_length).join(total, "gene_id").withColumn("weight", F.least(F.col("total").cast("double"), F.lit(cap)) if weighted else F.lit(1.0)).withColumn("class", by if by is not None else F.lit("all"))
    weights = g.groupBy("class").agg(F.sum("weight").alias("all_weight"))
    sums = percentiles.join(g, "gene_id").groupBy("class", F.col("bin").cast("int").alias("bin")).agg(F.sum(F.col("weight") * F.col("bases") / (F.col("total") / 100)).alias("s"))
    every = weights.select("class", "all_weight", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("bin")).join(sums, ["class", "bin"], "left")
    means = every.select("class", "bin", (F.coalesce("s", F.lit(0.0)) / F.col("all_weight")).alias("mean"))
    peak = F.max("mean").over(Window.partitionBy("class"))  # 100 rows
    return means.withColumn("percent", F.coalesce(F.try_divide(F.col("mean") * 100, peak), F.lit(0.0)))


def stratified_gene_body(genes: DataFrame, percentiles: DataFrame, min_support: int) -> DataFrame:
    return gene_body(genes, percentiles, min_support, by=length_class("gene_length"), min_length=0)


def stratified_three_prime(genes: DataFrame, percentiles: DataFrame, three_prime: DataFrame, min_support: int, p: ThreePrime) -> DataFrame:
    """3' profile of each length stratum but the shortest; anchor bins are rounded down here."""
    t = gene_table(genes, percentiles, three_prime, min_support, p, floor_anchor=True).withColumn("stratum", length_stratum("gene_length")).filter("stratum <> 'all'")
    return three_prime_profile(t, three_prime, p, ["stratum"])
