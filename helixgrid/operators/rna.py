"""RNA-seq metrics. Records: qname, flag, contig, pos0, mapq, cigar, and columns that order them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators.annotation import REGIONS, spliced_position
from helixgrid.operators.contamination import midpoint_hits
from helixgrid.operators.intervals import range_join


def fail_reason(mapq: int = 10, read2_only: bool = False) -> Column:
    """The first test that a record fails; null if it passes."""
    out = F.when(G.flag_is("flag", G.UNMAPPED), "unmapped").when(G.flag_is("flag", G.SECONDARY | G.SUPPLEMENTARY), "secondary").when(G.flag_is("flag", G.QC_FAIL | G.DUPLICATE), "qc_fail_or_duplicate").when(F.coalesce("mapq", F.lit(255)) < mapq, "low_mapq")
    return out.when(~G.flag_is("flag", G.LAST), "not_read_2") if read2_only else out


def filter_counts(records: DataFrame, mapq: int = 10) -> DataFrame:
    return records.groupBy(F.coalesce(fail_reason(mapq), F.lit("passed")).alias("reason")).agg(F.count(F.lit(1)).alias("count"))


def passing(records: DataFrame, mapq: int = 10) -> DataFrame:
    return records.filter(fail_reason(mapq).isNull())


def mito_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("reads"), F.count_if(F.lower("contig").isin(*G.RNA_MITO)).alias("mito"))


def counters(records: DataFrame, intervals: DataFrame | None, id_cols: list[str], rdna_contigs: tuple[str, ...] = (), bin_size: int = 1_000) -> DataFrame:
    """aligned_qc_reads, mtdna_reads and rdna_reads of passing records: a read is ribosomal by its contig, or by its match midpoint in an interval (chrom, start, end)."""
    by_contig = G.normalize_chrom("contig").isin(*[c.lower().removeprefix("chr") for c in rdna_contigs]) if rdna_contigs else F.lit(False)
    if intervals is not None:
        marked = records.join(midpoint_hits(records, intervals, id_cols, bin_size).withColumn("_hit", F.lit(True)), id_cols, "left")
    else:
        marked = records.withColumn("_hit", F.lit(None).cast("boolean"))
    return marked.agg(F.count(F.lit(1)).alias("aligned_qc_reads"), F.count_if(F.lower("contig").isin(*G.RNA_MITO)).alias("mtdna_reads"), F.count_if(by_contig | F.coalesce("_hit", F.lit(False))).alias("rdna_reads"))


def merge_counts(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Counts of several inputs or windows as one: numbers of equal keys are summed."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    numbers = [c for c in every.columns if c not in keys]
    return every.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in numbers]) if keys else every.agg(*[F.sum(c).alias(c) for c in numbers])


def first_pairs(pairs: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n pairs in order, after which a search for pairs may stop. Top-n per partition first; no global sort."""
    return pairs.orderBy(*order).limit(n)


def autosomal(records: DataFrame) -> DataFrame:
    return records.filter(G.is_autosome("contig"))


def read_blocks(records: DataFrame, id_cols: list[str]) -> DataFrame:
    """ids, chrom, start, end of each aligned block."""
    return records.select(*id_cols, G.normalize_chrom("contig").alias("chrom"), F.explode(G.aligned_blocks("cigar", "pos0")).alias("b")).select(*id_cols, "chrom", "b.start", "b.end")


def classify_reads(records: DataFrame, index: DataFrame, id_cols: list[str], bin_size: int) -> DataFrame:
    """ids and label: Exons, else Introns, else TSS_up_1kb (any flank), else Intergenic. Reads of chromosomes the index lacks are left out."""
    feats = index.select("chrom", F.col("start").alias("f_start"), F.col("end").alias("f_end"), "region")
    chroms = index.select("chrom").distinct()
    known = read_blocks(records, id_cols).join(chroms, "chrom", "left_semi")
    met = range_join(known, feats, "chrom", ("start", "end"), ("f_start", "f_end"), bin_size)
    per = met.groupBy(*id_cols).agg(F.bool_or(F.col("region").isin(*REGIONS[:4])).alias("exon"), F.bool_or(F.col("region") == "Introns").alias("intron"), F.bool_or(F.col("region").isin(*REGIONS[5:])).alias("flank"))
    reads = records.select(*id_cols, G.normalize_chrom("contig").alias("chrom")).join(chroms, "chrom", "left_semi").drop("chrom")
    label = F.when(F.col("exon"), "Exons").when(F.col("intron"), "Introns").when(F.col("flank"), "TSS_up_1kb").otherwise("Intergenic")
    return reads.join(per, id_cols, "left").select(*id_cols, label.alias("label"))


def gene_bins(blocks: DataFrame, exons: DataFrame, bin_bp: int, max_bp: int, join_bin: int) -> tuple[DataFrame, DataFrame]:
    """Bases per (gene_id, percentile 0..99) and per (gene_id, 3' bin), from block x exon overlaps.

    exons: rows of spliced_offsets(), one transcript per gene. Only the overlap of a block and an exon is expanded.
    """
    named = exons.withColumn("chrom", G.normalize_chrom("chrom")).select("chrom", F.col("start").alias("e_start"), F.col("end").alias("e_end"), "gene_id", "strand", "offset", "total_length")
    met = range_join(blocks, named, "chrom", ("start", "end"), ("e_start", "e_end"), join_bin)
    # the overlap is a run of spliced positions; its ends follow from the strand
    lo, hi = F.greatest("start", "e_start"), F.least("end", "e_end") - 1
    minus = F.col("strand") == "-"
    first = F.col("offset") + F.when(minus, F.col("e_end") - 1 - hi).otherwise(lo - F.col("e_start"))
    runs = met.select("gene_id", "total_length", first.alias("a"), (first + hi - lo).alias("z"))
    # only bin borders are expanded: a run adds its length to each bin it touches
    pct = lambda p: F.floor(100 * p / F.col("total_length")).cast("bigint")
    by_pct = runs.withColumn("bin", F.explode(F.sequence(pct(F.col("a")), pct(F.col("z")))))
    n = F.col("total_length")
    b0, b1 = F.ceil(F.col("bin") * n / 100), F.ceil((F.col("bin") + 1) * n / 100)
    percentiles = by_pct.groupBy("gene_id", "bin").agg(F.sum(F.least(F.col("z") + 1, b1) - F.greatest(F.col("a"), b0)).cast("bigint").alias("bases"))
    t0, t1 = n - 1 - F.col("z"), n - 1 - F.col("a")
    by_3p = runs.withColumn("t0", t0).withColumn("t1", F.least(t1, F.lit(max_bp - 1))).filter("t0 <= t1").withColumn("bin", F.explode(F.sequence(F.floor(F.col("t0") / bin_bp), F.floor(F.col("t1") / bin_bp))))
    three = by_3p.groupBy("gene_id", "bin").agg(F.sum(F.least(F.col("t1") + 1, (F.col("bin") + 1) * bin_bp) - F.greatest("t0", F.col("bin") * bin_bp)).cast("bigint").alias("bases"))
    return percentiles.filter("bases > 0"), three.filter("bases > 0")


def mate_pairs(records: DataFrame, order: list[str]) -> DataFrame:
    """Mates by name in input order: records (1, 2), (3, 4) .. of a name, if one is the first and the other not. r1 is the first."""
    w = Window.partitionBy("qname").orderBy(*order)
    cols = [c for c in records.columns if c != "qname"]
    numbered = records.withColumn("_i", F.row_number().over(w) - 1).withColumn("_first", G.flag_is("flag", G.FIRST))
    pairs = numbered.groupBy("qname", F.floor(F.col("_i") / 2).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_first").alias("_f"), F.min_by(F.struct(*cols), F.struct((~F.col("_first")).alias("l"), "_i")).alias("r1"), F.max_by(F.struct(*cols), F.struct((~F.col("_first")).alias("l"), "_i")).alias("r2"))
    return pairs.filter("_n = 2 and _f = 1").select("qname", F.col("_p").alias("pair_no"), "r1", "r2")


def inner_distances(pairs: DataFrame, exons: DataFrame, low: int = -1_000, high: int = 2_000, join_bin: int = 1_024) -> DataFrame:
    """qname, inner, r1_reverse, r2_reverse, gene strand of pairs whose mates' midpoints hit one gene, and the same.

    A midpoint that several genes hold counts if all are on one strand; then the gene with the smallest id is meant.
    Both ends of the fragment must lie in the gene's exons; the distance is spliced. exons: rows of spliced_offsets(), one transcript per gene.
    """
    e = exons.select(G.normalize_chrom("chrom").alias("e_chrom"), F.col("start"), F.col("end"), "gene_id", "strand", "offset")
    flat = pairs.select(F.struct("qname", "pair_no").alias("pid"), "r1", "r2")
    sides = flat.select("pid", F.explode(F.array(F.struct(F.lit(1).alias("side"), "r1.*"), F.struct(F.lit(2).alias("side"), "r2.*"))).alias("m")).select("pid", "m.side", G.normalize_chrom("m.contig").alias("chrom"), G.match_span("m.cigar", "m.pos0").alias("s"), G.aligned_length("m.cigar").alias("aligned"), G.flag_is("m.flag", G.REVERSE).alias("reverse"))
    spans = sides.filter("s is not null").withColumn("mid", G.midpoint("s.start", "s.end"))
    points = spans.select("pid", "side", "chrom", "mid", (F.col("mid") + 1).alias("next"))
    hit = range_join(points, e.withColumnRenamed("e_chrom", "chrom").select("chrom", "start", "end", "gene_id", "strand"), "chrom", ("mid", "next"), ("start", "end"), join_bin)
    gene = hit.groupBy("pid", "side").agg(F.min("gene_id").alias("gene_id"), F.min("strand").alias("strand"), F.count_distinct("strand").alias("_s")).filter("_s = 1").drop("_s")
    known = spans.join(gene, ["pid", "side"], "left")
    both = known.groupBy("pid").agg(F.count_distinct("chrom").alias("chroms"), F.count("gene_id").alias("genes"), F.min("gene_id").alias("g1"), F.max("gene_id").alias("g2"), F.min("chrom").alias("chrom"), F.min("s.start").alias("p1"), (F.max("s.end") - 1).alias("p2"), F.sum("aligned").alias("aligned"), F.max_by("reverse", -F.col("side")).alias("r1_reverse"), F.max_by("reverse", "side").alias("r2_reverse"), F.min("strand").alias("strand"))
    same = both.filter("chroms = 1 and genes = 2 and g1 = g2")
    ends = same.withColumnRenamed("strand", "gene_strand").select("*", F.explode(F.array("p1", "p2")).alias("p")).join(e, (F.col("g1") == F.col("gene_id")) & (F.col("p") >= F.col("start")) & (F.col("p") < F.col("end"))).withColumn("spliced", spliced_position(F.col("p")))
    got = ends.groupBy("pid", "aligned", "r1_reverse", "r2_reverse", "gene_strand", "p1", "p2").agg(F.count_distinct("p").alias("n"), (F.max("spliced") - F.min("spliced") + 1).alias("fragment")).filter("n = case when p1 = p2 then 1 else 2 end")
    return got.select((F.col("fragment") - F.col("aligned")).alias("inner_distance"), "r1_reverse", "r2_reverse", "gene_strand").filter(F.col("inner_distance").between(low, high))


def pair_summary(distances: DataFrame) -> DataFrame:
    """Orientation and strandedness counts, mean and exact median distance, and the library's label."""
    fr, rf = ~F.col("r1_reverse") & F.col("r2_reverse"), F.col("r1_reverse") & ~F.col("r2_reverse")
    against = F.col("r1_reverse") == (F.col("gene_strand") == "+")
    s = distances.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(fr).alias("fr"), F.count_if(rf).alias("rf"), F.count_if(~fr & ~rf).alias("other"), F.count_if(~against).alias("stranded_forward"), F.count_if(against).alias("stranded_reverse"), F.avg("inner_distance").alias("mean_distance"), F.percentile("inner_distance", 0.5).alias("median_distance"))
    return s.withColumn("label", G.strandedness("stranded_forward", "stranded_reverse", "fr", "rf", "pairs"))


def junctions(records: DataFrame) -> DataFrame:
    """chrom, start, end, strand (of the read), reads, min_bucket (of the reads' names)."""
    spans = records.select(G.normalize_chrom("contig").alias("chrom"), F.when(G.flag_is("flag", G.REVERSE), "-").otherwise("+").alias("strand"), G.hash_bucket("qname").alias("bucket"), F.explode(G.introns("cigar", "pos0")).alias("j"))
    return spans.groupBy("chrom", F.col("j.start").alias("start"), F.col("j.end").alias("end"), "strand").agg(F.count(F.lit(1)).alias("reads"), F.min("bucket").alias("min_bucket"))


def classify_junctions(found: DataFrame, known: DataFrame) -> DataFrame:
    """Adds novelty: Known, PartialNovel (an end is known) or Novel. known: chrom, start, end of annotated introns."""
    k = known.select(G.normalize_chrom("chrom").alias("chrom"), "start", "end")
    both, start, end = k.distinct().withColumn("_b", F.lit(1)), k.select("chrom", "start").distinct().withColumn("_s", F.lit(1)), k.select("chrom", "end").distinct().withColumn("_e", F.lit(1))
    j = found.join(both, ["chrom", "start", "end"], "left").join(start, ["chrom", "start"], "left").join(end, ["chrom", "end"], "left")
    label = F.when(F.col("_b").isNotNull(), "Known").when(F.col("_s").isNotNull() | F.col("_e").isNotNull(), "PartialNovel").otherwise("Novel")
    return j.select(*found.columns, label.alias("novelty"))


def junction_metrics(classified: DataFrame) -> DataFrame:
    return classified.groupBy("novelty").agg(F.count(F.lit(1)).alias("junctions"), F.sum("reads").alias("reads"))


def junction_saturation(classified: DataFrame) -> DataFrame:
    """novelty, percent (10 .. 100), junctions that would be seen with that share of reads."""
    level = F.explode(F.sequence(F.lit(10), F.lit(100), F.lit(10)))
    return classified.select("novelty", "min_bucket", level.alias("percent")).groupBy("novelty", "percent").agg(F.count_if(F.col("min_bucket") < F.col("percent")).alias("junctions"))


def fragments(pairs: DataFrame) -> DataFrame:
    """qname, contig, start, end, blocks of pairs on one contig with mates that point in different directions; blocks of both, merged where they overlap or touch."""
    rev = lambda r: G.flag_is(f"{r}.flag", G.REVERSE)
    both = pairs.filter((F.col("r1.contig") == F.col("r2.contig")) & (rev("r1") != rev("r2")))
    blocks = F.array_sort(F.concat(G.aligned_blocks("r1.cigar", "r1.pos0"), G.aligned_blocks("r2.cigar", "r2.pos0")))

    def step(acc, b):
        joins = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= b["start"])
        merged = F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], b["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(merged))).otherwise(F.concat(acc, F.array(b)))

    out = both.select("qname", F.col("r1.contig").alias("contig"), F.aggregate(blocks, F.array().cast("array<struct<start:bigint,end:bigint>>"), step).alias("blocks")).filter(F.size("blocks") > 0)
    return out.select("qname", "contig", F.element_at("blocks", 1)["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"), "blocks")
