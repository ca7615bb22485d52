"""Transcripts, genes and their features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.functions.genomics import normalize_chrom

#: Region types in order of priority. Names and order decide the results.
REGIONS = ("CDS_Exons", "5'UTR_Exons", "3'UTR_Exons", "Exons", "Introns", "TSS_up_1kb", "TSS_up_5kb", "TSS_up_10kb", "TES_down_1kb", "TES_down_5kb", "TES_down_10kb")
#: Distances of the flanks from transcript ends. Fixed values.
FLANKS = ((0, 1_000, "1kb"), (1_000, 5_000, "5kb"), (5_000, 10_000, "10kb"))


def exon_rows(transcripts: DataFrame) -> DataFrame:
    """A row per exon: the transcript's columns, start, end, length, exon_no (in genomic order)."""
    return transcripts.select("*", F.posexplode("exons").alias("exon_no", "exon")).select(*transcripts.columns, "exon_no", F.col("exon.start").alias("start"), F.col("exon.end").alias("end")).drop("exons").withColumn("length", F.col("end") - F.col("start"))


def spliced_offsets(exons: DataFrame) -> DataFrame:
    """Adds `offset`, the bases of the transcript 5' of the exon, and `total_length`."""
    by = Window.partitionBy("transcript_id")
    upstream = F.when(F.col("strand") == "-", F.sum("length").over(by.orderBy(F.desc("start")))).otherwise(F.sum("length").over(by.orderBy("start")))
    return exons.withColumn("offset", upstream - F.col("length")).withColumn("total_length", F.sum("length").over(by))


def spliced_position(pos: Column) -> Column:
    """Distance of a genomic position from the 5' end of its transcript; on rows of spliced_offsets()."""
    return F.col("offset") + F.when(F.col("strand") == "-", F.col("end") - 1 - pos).otherwise(pos - F.col("start"))


def spliced_range(start: Column, end: Column, from_3p: bool = False) -> Column:
    """struct(start, end) of the part of a genomic range that an exon holds, in distances from the transcript's 5' or 3' end; null without one. On rows of spliced_offsets()."""
    lo, hi = F.greatest(start, F.col("start")), F.least(end, F.col("end"))
    first = F.col("offset") + F.when(F.col("strand") == "-", F.col("end") - hi).otherwise(lo - F.col("start"))
    last = first + hi - lo
    a, z = (F.greatest(F.col("total_length") - last, F.lit(0)), F.greatest(F.col("total_length") - first, F.lit(0))) if from_3p else (first, last)
    return F.when(lo < hi, F.struct(a.alias("start"), z.alias("end")))


def genomic_position(spliced: Column) -> Column:
    """The genomic place of a distance from the 5' end, null unless this exon holds it; on rows of spliced_offsets()."""
    within = spliced - F.col("offset")
    return F.when((within >= 0) & (within < F.col("end") - F.col("start")), F.when(F.col("strand") == "-", F.col("end") - 1 - within).otherwise(F.col("start") + within))


def introns(exons: DataFrame) -> DataFrame:
    """Gaps between consecutive exons of a transcript."""
    nxt = F.lead("start").over(Window.partitionBy("transcript_id").orderBy("start"))
    return exons.withColumn("_n", nxt).filter("_n > end").select(*[c for c in exons.columns if c not in ("start", "end", "length", "exon_no")], F.col("end").alias("start"), F.col("_n").alias("end"))


def with_ends(transcripts: DataFrame) -> DataFrame:
    """Adds start, end, total_length, five_prime_end and three_prime_end (the outer coordinates by strand)."""
    first, last = F.array_min(F.transform("exons", lambda e: e["start"])), F.array_max(F.transform("exons", lambda e: e["end"]))
    total = F.aggregate("exons", F.lit(0).cast("bigint"), lambda s, e: s + e["end"] - e["start"])
    minus = F.col("strand") == "-"
    out = transcripts.withColumn("tx_start", first).withColumn("tx_end", last).withColumn("total_length", total)
    return out.withColumn("five_prime_end", F.when(minus, F.col("tx_end")).otherwise(F.col("tx_start"))).withColumn("three_prime_end", F.when(minus, F.col("tx_start")).otherwise(F.col("tx_end")))


def pick_isoforms(transcripts: DataFrame, how: str = "longest", min_length: int = 0) -> DataFrame:
    """One transcript per gene: longest, shortest, median, common3p or canonical; ties go to the smaller id.

    Isoforms are ordered by spliced length. median is the (n div 2)-th; canonical prefers MANE, then the canonical tag,
    then the best APPRIS level, then the best support level, then the median; common3p takes the most common 3' end
    and of those the isoform that reaches furthest 5'.
    """
    t = with_ends(transcripts).filter(F.col("total_length") >= min_length)
    gene = Window.partitionBy("gene_id")
    by_length = gene.orderBy("total_length", "transcript_id")
    t = t.withColumn("_i", F.row_number().over(by_length) - 1).withColumn("_n", F.count(F.lit(1)).over(gene))
    median = (F.col("_i") != F.floor(F.col("_n") / 2)).cast("int")
    if how == "longest":
        order = [F.desc("_i")]
    elif how == "shortest":
        order = [F.asc("_i")]
    elif how == "median":
        order = [median]
    elif how == "canonical":
        level = lambda c: F.when(F.col(c).between(1, 5), F.col(c)).otherwise(9)
        order = [(~F.coalesce(F.col("mane_select"), F.lit(False))).cast("int"), (~F.coalesce(F.col("ensembl_canonical"), F.lit(False))).cast("int"), level("appris"), level("tsl"), F.when((level("appris") == 9) & (level("tsl") == 9), median).otherwise(0), F.asc("_i")]
    elif how == "common3p":
        t = t.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("gene_id", "three_prime_end")))
        order = [F.desc("_c"), F.when(F.col("strand") == "-", -F.col("five_prime_end")).otherwise(F.col("five_prime_end")), F.asc("transcript_id")]
    else:
        raise ValueError(f"unknown isoform choice {how}")
    return t.withColumn("_r", F.row_number().over(gene.orderBy(*order))).filter("_r = 1").drop("_r", "_i", "_n", "_c")


def divergent_genes(transcripts: DataFrame, window: int) -> DataFrame:
    """Genes whose isoforms' 3' ends lie more than `window` apart."""
    t = with_ends(transcripts)
    return t.groupBy("gene_id").agg((F.max("three_prime_end") - F.min("three_prime_end")).alias("spread")).filter(F.col("spread") > window)


def feature_events(transcripts: DataFrame) -> DataFrame:
    """chrom, region, start, end of every feature of every transcript, before they are resolved."""
    exons = exon_rows(transcripts)
    plus = F.col("strand") == "+"
    coding = F.col("cds_start").isNotNull() & F.col("cds_end").isNotNull()
    s, e, cs, ce = F.col("start"), F.col("end"), F.col("cds_start"), F.col("cds_end")

    def item(region: Column | str, a: Column, b: Column) -> Column:
        return F.struct((F.lit(region) if isinstance(region, str) else region).alias("region"), a.cast("bigint").alias("start"), b.cast("bigint").alias("end"))

    left, right = item(F.when(plus, "5'UTR_Exons").otherwise("3'UTR_Exons"), s, F.least(e, cs)), item(F.when(plus, "3'UTR_Exons").otherwise("5'UTR_Exons"), F.greatest(s, ce), e)
    parts = F.when(coding, F.array(item("CDS_Exons", F.greatest(s, cs), F.least(e, ce)), left, right)).otherwise(F.array(item("Exons", s, e)))
    of_exons = exons.select("chrom", F.explode(parts).alias("f"))
    of_introns = introns(exons).select("chrom", item("Introns", s, e).alias("f"))
    t = with_ends(transcripts)
    tss, tes = F.col("five_prime_end"), F.col("three_prime_end")
    floor0 = lambda c: F.greatest(c, F.lit(0))
    flanks = []
    for near, far, name in FLANKS:
        up, down = f"TSS_up_{name}", f"TES_down_{name}"
        flanks += [F.when(plus, item(up, floor0(tss - far), floor0(tss - near))).otherwise(item(up, tss + near, tss + far)), F.when(plus, item(down, tes + near, tes + far)).otherwise(item(down, floor0(tes - far), floor0(tes - near)))]
    of_ends = t.select("chrom", F.explode(F.array(*flanks)).alias("f"))
    every = of_exons.unionByName(of_introns).unionByName(of_ends)
    return every.select(normalize_chrom("chrom").alias("chrom"), "f.region", "f.start", "f.end").filter("start < end")


def feature_index(transcripts: DataFrame) -> DataFrame:
    """chrom, start, end, region: disjoint stretches, each with the region of highest priority there; equal neighbours are one.

    The sweep keeps one running count per region; positions are summed first, so its input is at most the distinct
    positions of a chromosome.
    """
    f = feature_events(transcripts)
    ends = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))))
    events = f.select("chrom", "region", ends.alias("e")).groupBy("chrom", F.col("e.at").alias("at")).agg(*[F.sum(F.when(F.col("region") == r, F.col("e.d")).otherwise(0)).alias(f"d{i}") for i, r in enumerate(REGIONS)])
    w = Window.partitionBy("chrom").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    label = F.coalesce(*[F.when(F.sum(f"d{i}").over(upto) > 0, r) for i, r in enumerate(REGIONS)])
    swept = events.select("chrom", F.col("at").alias("start"), F.lead("at").over(w).alias("end"), label.alias("region")).filter("end is not null and region is not null")
    w2 = Window.partitionBy("chrom").orderBy("start")
    fresh = (F.lag("region").over(w2).eqNullSafe(F.col("region")) & F.lag("end").over(w2).eqNullSafe(F.col("start"))).cast("int")
    islands = swept.withColumn("_new", 1 - fresh).withColumn("_i", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("chrom", "_i", "region").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end", "region")


def feature_sizes(index: DataFrame) -> DataFrame:
    return index.groupBy("region").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
