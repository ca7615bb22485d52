"""Metrics of alignment records. Records: qname, flag, contig, pos0, mapq, cigar, tlen (and de, seq, qual, md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G


def _count(condition) -> object:
    return F.count_if(condition)


def flagstat(records: DataFrame) -> DataFrame:
    """One row of counts. A record is primary without the secondary and supplementary bits."""
    is_ = lambda bits: G.flag_is("flag", bits)
    mapped = ~is_(G.UNMAPPED)
    return records.agg(
        F.count(F.lit(1)).alias("total"), _count(mapped).alias("mapped"), _count(is_(G.UNMAPPED)).alias("unmapped"),
        _count(~is_(G.SECONDARY | G.SUPPLEMENTARY)).alias("primary"), _count(is_(G.SECONDARY)).alias("secondary"), _count(is_(G.SUPPLEMENTARY)).alias("supplementary"),
        _count(is_(G.DUPLICATE)).alias("duplicates"), _count(is_(G.QC_FAIL)).alias("qc_fail"), _count(is_(G.PAIRED)).alias("paired"),
        _count(is_(G.PAIRED) & is_(G.PROPER)).alias("proper"), _count(is_(G.PAIRED) & mapped & is_(G.MATE_UNMAPPED)).alias("singleton"),
        _count(is_(G.PAIRED) & is_(G.UNMAPPED) & ~is_(G.MATE_UNMAPPED)).alias("orphan"), _count(is_(G.PAIRED) & mapped & ~is_(G.MATE_UNMAPPED) & ~is_(G.PROPER)).alias("discordant"),
    )


def mapq_histogram(records: DataFrame) -> DataFrame:
    """A missing mapq counts as 255."""
    return records.groupBy(F.coalesce("mapq", F.lit(255)).alias("mapq")).agg(F.count(F.lit(1)).alias("count"))


def low_mapq(records: DataFrame, threshold: int) -> DataFrame:
    return records.agg(_count(F.coalesce("mapq", F.lit(255)) < threshold).alias("low_mapq"))


def insert_histogram(records: DataFrame) -> DataFrame:
    """Template lengths above 0 of paired records."""
    return records.filter(G.flag_is("flag", G.PAIRED) & (F.col("tlen") > 0)).groupBy(F.col("tlen").alias("insert_size")).agg(F.count(F.lit(1)).alias("count"))


def cigar_totals(records: DataFrame) -> DataFrame:
    """Operations and bases of each kind."""
    return records.select(F.explode(G.cigar_ops("cigar")).alias("x")).groupBy(F.col("x.op").alias("op")).agg(F.count(F.lit(1)).alias("operations"), F.sum(F.col("x.len").cast("bigint")).alias("bases"))


def contig_counts(records: DataFrame) -> DataFrame:
    """Per contig; unmapped records count under *."""
    name = F.when(G.flag_is("flag", G.UNMAPPED), "*").otherwise(F.coalesce("contig", F.lit("unknown")))
    mapped = ~G.flag_is("flag", G.UNMAPPED)
    primary = mapped & ~G.flag_is("flag", G.SECONDARY | G.SUPPLEMENTARY)
    return records.groupBy(name.alias("contig")).agg(F.count(F.lit(1)).alias("records"), _count(mapped).alias("mapped"), _count(primary).alias("primary_mapped"), F.sum(F.when(mapped, G.reference_span("cigar")).otherwise(0)).alias("reference_bases"))


def accuracy_histogram(records: DataFrame) -> DataFrame:
    return records.filter("de is not null").groupBy(G.accuracy_bin("de").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def accuracy_summary(records: DataFrame) -> DataFrame:
    """Count, mean, mode (the lowest of the most common bins) and median (nearest rank)."""
    hist = accuracy_histogram(records)
    w = Window.partitionBy(F.lit(0)).orderBy("bin")  # at most 10,001 bins
    ranked = hist.withColumn("cum", F.sum("count").over(w)).withColumn("n", F.sum("count").over(Window.partitionBy(F.lit(0))))
    of_hist = ranked.agg(
        (F.max_by("bin", F.struct("count", -F.col("bin"))) / 10_000).alias("mode"),
        (F.min(F.when(F.col("cum") >= F.floor((F.col("n") - 1) * 0.5 + 0.5) + 1, F.col("bin"))) / 10_000).alias("median"),
    )
    of_rows = records.filter("de is not null").agg(F.count(F.lit(1)).alias("n"), F.avg(G.accuracy("de")).alias("mean"))
    return of_rows.crossJoin(of_hist)  # one row each


#: Insert classes: name -> (first, last) size, both included. Fixed values.
INSERT_CLASSES = {"sub_nucleosomal": (30, 142), "mono_nucleosomal": (143, 220), "di_nucleosomal": (320, 480), "short_cfdna": (100, 150), "mono_cfdna": (151, 220), "large_fragment": (1_001, 2**31 - 1)}
#: Where the peaks are sought. Fixed values.
PEAKS = {"mono_nucleosomal_peak": (140, 200), "di_nucleosomal_peak": (300, 450)}


def insert_metrics(hist: DataFrame) -> DataFrame:
    """Class counts, ratios (null without a denominator) and peaks of the 7-point moving mean; no row without inserts."""
    classes = hist.agg(F.sum("count").alias("total_inserts"), *[F.sum(F.when(F.col("insert_size").between(a, b), F.col("count")).otherwise(0)).alias(f"{k}_count") for k, (a, b) in INSERT_CLASSES.items()]).filter("total_inserts > 0")
    lo, hi = min(a for a, _ in PEAKS.values()) - 3, max(b for _, b in PEAKS.values()) + 3
    line = hist.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias("insert_size")).join(hist, "insert_size", "left")
    smooth = line.select("insert_size", (F.sum(F.coalesce("count", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("insert_size").rowsBetween(-3, 3)) / 7.0).alias("v"))  # a few hundred rows
    peaks = smooth.agg(*[F.max_by(F.when(F.col("insert_size").between(a, b), F.col("insert_size")), F.when(F.col("insert_size").between(a, b) & (F.col("v") > 0), F.struct("v", -F.col("insert_size")))).alias(k) for k, (a, b) in PEAKS.items()])
    out = classes.crossJoin(peaks)  # one row each
    return out.select(
        "*", F.try_divide("short_cfdna_count", "mono_cfdna_count").alias("cfdna_ratio"), F.try_divide("mono_nucleosomal_count", "di_nucleosomal_count").alias("mono_di_ratio"),
        G.fraction("sub_nucleosomal_count", "total_inserts").alias("short_fraction"), G.fraction("mono_nucleosomal_count", "total_inserts").alias("mono_fraction"), G.fraction("di_nucleosomal_count", "total_inserts").alias("di_fraction"),
    )


def _query_places(kinds: str) -> Column:
    """1-based places in the stored sequence that operations of some kinds hold."""
    return F.aggregate(
        G.cigar_ops("cigar"),
        F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.when(x["op"].isin(*"MIS=X"), x["len"]).otherwise(0)).alias("at"),
            F.when(x["op"].isin(*kinds) & (x["len"] > 0), F.concat(s["out"], F.sequence(s["at"], s["at"] + x["len"] - 1))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )


def _md_mismatches(records: DataFrame) -> DataFrame:
    """mate, cycle, ref, query of each mismatch of MD that lies in the sequence."""
    read_cycles = _query_places("M=X")
    walked = F.aggregate(
        G.md_elements("md"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<i:int,ref:string>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.when(x.rlike(r"^\d+$"), x.try_cast("int")).when(x.startswith("^"), 0).otherwise(1)).alias("at"),
            F.when(x.rlike("^[A-Za-z]$"), F.concat(s["out"], F.array(F.struct((s["at"] + 1).alias("i"), F.upper(x).alias("ref"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    mate = F.when(G.flag_is("flag", G.LAST), 2).otherwise(1)
    found = records.filter("md is not null").select(mate.alias("mate"), "seq", read_cycles.alias("cycles"), F.explode(walked).alias("m"))
    at = F.try_element_at("cycles", F.col("m.i"))
    return found.select("mate", (at - 1).alias("cycle"), F.col("m.ref").alias("ref"), F.upper(F.substr("seq", at, F.lit(1))).alias("query")).filter("cycle is not null and query <> ''")


def md_substitutions(records: DataFrame) -> DataFrame:
    """mate, cycle (0-based in the stored sequence), ref, query of every mismatch that MD and CIGAR tell.

    Records: flag, cigar, md, seq. Matches and mismatches of MD are walked over the query bases that M, = and X hold;
    insertions and soft clips take query bases that MD doesn't see. Records without MD are left out.
    """
    return _md_mismatches(records).filter("ref <> query")


def mismatch_cycles(records: DataFrame) -> DataFrame:
    """mate and cycle of every mismatch: those of MD, or of records without MD the bases of X."""
    mate = F.when(G.flag_is("flag", G.LAST), 2).otherwise(1)
    by_x = records.filter("md is null").select(mate.alias("mate"), F.length("seq").alias("n"), F.explode(_query_places("X")).alias("at"))
    return _md_mismatches(records).select("mate", "cycle").unionByName(by_x.filter("at <= n").select("mate", (F.col("at") - 1).alias("cycle")))


def cycle_rates(records: DataFrame) -> DataFrame:
    """per_cycle() with mismatches and their rate. Records: flag, cigar, md, seq, qual."""
    wrong = mismatch_cycles(records).groupBy("mate", "cycle").agg(F.count(F.lit(1)).alias("mismatches"))
    return per_cycle(records).join(wrong, ["mate", "cycle"], "left").na.fill(0, ["mismatches"]).withColumn("mismatch_rate", F.col("mismatches") / F.col("reads"))


def quality_counts(records: DataFrame) -> DataFrame:
    """Bases of each quality. Records: qual (array of int)."""
    return records.select(F.explode("qual").alias("quality")).groupBy("quality").agg(F.count(F.lit(1)).alias("count"))


def per_cycle(records: DataFrame) -> DataFrame:
    """Bases and quality sums of each mate and cycle. Records: flag, seq, qual (array of int)."""
    mate = F.when(G.flag_is("flag", G.LAST), 2).otherwise(1)
    bases = records.select(mate.alias("mate"), "qual", F.posexplode(F.filter(F.split("seq", ""), lambda b: b != "")).alias("cycle", "base"))
    kind = G.base_class("base")
    return bases.groupBy("mate", "cycle").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.coalesce(F.try_element_at("qual", F.col("cycle") + 1), F.lit(0)).cast("bigint")).alias("quality_sum"), *[F.count_if(kind == b).alias(f"n_{b.lower()}") for b in "ACGTN"])
