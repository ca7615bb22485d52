"""DNA coverage. Records: flag, contig, pos0, mapq, cigar; contigs: contig, length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators.intervals import depth_segments, range_join

LEVELS = (1, 5, 10, 20, 30)


def passing(records: DataFrame, mapq: int = 0) -> DataFrame:
    """Mapped primary records of at least that quality (missing: 255); duplicates and failed ones count."""
    return records.filter(~G.flag_is("flag", G.UNMAPPED | G.SECONDARY | G.SUPPLEMENTARY) & (F.coalesce("mapq", F.lit(255)) >= mapq))


def blocks(records: DataFrame) -> DataFrame:
    return records.select("contig", F.explode(G.aligned_blocks("cigar", "pos0")).alias("b")).select("contig", "b.start", "b.end")


def segments(records: DataFrame, mapq: int = 0) -> DataFrame:
    """contig, start, end, depth."""
    return depth_segments(blocks(passing(records, mapq)))


def depth_histogram(segs: DataFrame, contigs: DataFrame) -> DataFrame:
    """depth, bases; depth 0 is the reference's length less what is covered."""
    covered = segs.groupBy("depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    total = contigs.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"))
    known = segs.agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("c"))
    zero = total.crossJoin(known).select(F.lit(0).cast("bigint").alias("depth"), (F.col("n") - F.col("c")).alias("bases"))  # one row each
    return covered.select(F.col("depth").cast("bigint").alias("depth"), "bases").unionByName(zero.filter("bases > 0"))


def _levels(width) -> list:
    return [F.sum(F.coalesce(width * F.col("depth"), F.lit(0))).alias("depth_bases")] + [F.sum(F.when(F.col("depth") >= n, width).otherwise(0)).alias(f"bases_ge_{n}") for n in LEVELS]


def contig_depth(segs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Every contig, covered or not."""
    width = F.col("end") - F.col("start")
    per = segs.groupBy("contig").agg(*_levels(width))
    return contigs.join(per, "contig", "left").na.fill(0)


def span_depth(segs: DataFrame, spans: DataFrame, bin_size: int) -> DataFrame:
    """Depth within spans (contig, start, end and other columns); every span stays. Spans may overlap."""
    keys = spans.columns
    named = spans.withColumnsRenamed({"start": "span_start", "end": "span_end"})
    met = range_join(segs, named.withColumnRenamed("contig", "contig"), "contig", ("start", "end"), ("span_start", "span_end"), bin_size)
    width = F.least("end", "span_end") - F.greatest("start", "span_start")
    others = [c for c in keys if c not in ("contig", "start", "end")]
    per = met.groupBy("contig", "span_start", "span_end").agg(*_levels(width)).withColumnsRenamed({"contig": "_c", "span_start": "_s", "span_end": "_e"})
    joined = spans.join(per, (F.col("contig") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")), "left")
    numbers = ["depth_bases", *(f"bases_ge_{n}" for n in LEVELS)]
    return joined.select("contig", "start", "end", *others, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def summary(hist: DataFrame) -> DataFrame:
    """Mean depth, breadth in percent at each level and the median depth of a depth histogram."""
    w = Window.partitionBy(F.lit(0)).orderBy("depth")  # a histogram of depths
    ranked = hist.withColumn("cum", F.sum("bases").over(w)).withColumn("n", F.sum("bases").over(Window.partitionBy(F.lit(0))))
    return ranked.agg(
        F.sum("bases").alias("reference_bases"), G.fraction(F.sum(F.col("depth") * F.col("bases")), F.sum("bases")).alias("mean_depth"),
        F.min(F.when(F.col("cum") >= F.floor((F.col("n") - 1) * 0.5 + 0.5) + 1, F.col("depth"))).alias("median_depth"),
        *[G.percent(F.sum(F.when(F.col("depth") >= n, F.col("bases")).otherwise(0)), F.sum("bases")).alias(f"breadth_{n}") for n in LEVELS],
    )


def merge_inputs(per_input: DataFrame) -> DataFrame:
    """Contig depths of several inputs: lengths are the same contig's, depths add up."""
    return per_input.groupBy("contig").agg(F.max("length").alias("length"), F.sum("depth_bases").alias("depth_bases"), *[F.sum(f"bases_ge_{n}").alias(f"bases_ge_{n}") for n in LEVELS])


def window_gc(windows: DataFrame, reference: DataFrame, bin_size: int) -> DataFrame:
    """windows (contig, start, end and others) with gc: the share of G and C among A, C, G, T and U of the reference.

    reference: contig, start, seq in pieces of any length. Windows without such a base are left out. A window's bases
    are counted piece by piece and summed; sequences are not put together.
    """
    pieces = reference.select("contig", F.col("start").alias("piece_start"), (F.col("start") + F.length("seq")).alias("piece_end"), "seq")
    spans = windows.withColumn("window", F.struct(*windows.columns)).select("contig", "start", "end", "window")
    met = range_join(spans, pieces, "contig", ("start", "end"), ("piece_start", "piece_end"), bin_size)
    lo, hi = F.greatest("start", "piece_start"), F.least("end", "piece_end")
    part = F.substr("seq", (lo - F.col("piece_start") + 1).cast("int"), (hi - lo).cast("int"))
    count = lambda letters: F.length(part) - F.length(F.translate(part, letters, ""))
    per = met.select("window", count("GCgc").alias("g"), count("ATUatu").alias("a")).groupBy("window").agg(F.sum("g").alias("g"), F.sum("a").alias("a"))
    return per.filter("g + a > 0").select("window.*", (F.col("g") / (F.col("g") + F.col("a"))).alias("gc"))


def gc_bias(windows: DataFrame) -> DataFrame:
    """101 bins of GC percent. windows: gc (0..1), mean_depth. Empty bins are 0."""
    at = F.least(F.floor(F.col("gc") * 100 + 0.5), F.lit(100)).cast("int")
    per = windows.groupBy(at.alias("gc_percent")).agg(F.count(F.lit(1)).alias("window_count"), F.avg("mean_depth").alias("mean_depth"), (F.coalesce(F.stddev_samp("mean_depth"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("standard_error"))
    overall = windows.agg(F.coalesce(F.avg("mean_depth"), F.lit(0.0)).alias("overall"))
    every = windows.sparkSession.range(101).select(F.col("id").cast("int").alias("gc_percent")).join(per, "gc_percent", "left").crossJoin(overall)  # 101 rows and one
    return every.select("gc_percent", F.coalesce("window_count", F.lit(0)).alias("window_count"), F.coalesce("mean_depth", F.lit(0.0)).alias("mean_depth"), G.fraction(F.coalesce("mean_depth", F.lit(0.0)), "overall").alias("normalized_coverage"), F.coalesce("standard_error", F.lit(0.0)).alias("standard_error"))


def gc_bias_checks(bins: DataFrame) -> DataFrame:
    """at_average and gc_average of normalised coverage, mean standard error, and whether each is in order."""
    part = lambda a, b: F.avg(F.when(F.col("gc_percent").between(a, b) & (F.col("window_count") > 0), F.col("normalized_coverage")))
    sums = bins.agg(part(20, 25).alias("at_average"), part(60, 65).alias("gc_average"), F.avg(F.when(F.col("window_count") > 1, F.col("standard_error"))).alias("mean_se"))
    bad = lambda c: F.coalesce((F.col(c) < 0.5) | (F.col(c) > 1.8), F.lit(False))
    return sums.select("*", bad("at_average").alias("at_warning"), bad("gc_average").alias("gc_warning"), F.coalesce(F.col("mean_se") > 0.15, F.lit(False)).alias("noise_warning"))
