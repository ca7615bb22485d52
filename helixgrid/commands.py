"""From files to a module's files: `python -m helixgrid fastq reads.fastq.gz --output run1` and the like."""

from __future__ import annotations

import argparse
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixgrid import sources
from helixgrid.functions import genomics as G
from helixgrid.operators import annotation, contamination, profiles, rna, snapshot
from helixgrid.operators.intervals import range_join
from helixgrid.sinks import modules, report
from helixgrid.sinks.text import write_table
from helixgrid.sources.bam import bam_contigs

ROW = ["file_idx", "rec_no"]


def _kept(df: DataFrame) -> DataFrame:
    """The rows as a table in the session's shared folder: files are parsed once, whatever is computed from them."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="helixgrid-"))
    return df.checkpoint()


def run_fastq(spark: SparkSession, o: argparse.Namespace) -> None:
    pairs = None
    if o.mate:
        pairs = sources.read_paired_fastq(spark, o.inputs[0], o.mate, o.offset)
        reads = _kept(sources.read_fastq(spark, o.inputs, o.offset, 1).unionByName(sources.read_fastq(spark, o.mate, o.offset, 2)))
    else:
        reads = _kept(sources.read_fastq(spark, o.inputs, o.offset))
    modules.write_fastq(o.output, reads, pairs, o.sample, o.kmer, o.top, o.length_bin)


def run_align(spark: SparkSession, o: argparse.Namespace) -> None:
    modules.write_align(o.output, _kept(sources.read_bam(spark, o.inputs)), o.mapq, o.read_qc)


def run_dna(spark: SparkSession, o: argparse.Namespace) -> None:
    reference = sources.read_fasta(spark, o.reference, o.window).withColumnRenamed("chrom", "contig") if o.reference else None
    modules.write_dna(o.output, _kept(sources.read_bam(spark, o.inputs)), bam_contigs(spark, o.inputs[0]), o.window, o.mapq, sources.read_targets(spark, o.targets) if o.targets else None, o.targets, reference)


def run_contam(spark: SparkSession, o: argparse.Namespace) -> None:
    for path in o.inputs:
        records = _kept(contamination.primary(sources.read_bam(spark, path)))
        hits = contamination.interval_hits(records, sources.read_bed(spark, o.rdna_bed), ROW, 1_000) if o.rdna_bed else records.select(*ROW).limit(0)
        got = contamination.summary(records, hits, ROW, tuple(o.rdna_contigs)).first()
        counts = {"total_reads": got.total, "mapped_reads": records.filter(~G.flag_is("flag", G.UNMAPPED)).count(), "mtdna_reads": got.mito, "rdna_interval_reads": got.rdna_interval, "rdna_contig_reads": got.rdna_contig, "rdna_aligned_fraction": got.rdna_fraction}
        if o.rrna:
            screened = records.filter(contamination.to_screen(o.screen, o.mapq))
            counts |= {"rrna_kmer_reads_screened": screened.count(), "rrna_kmer_reads": contamination.kmer_hits(screened, contamination.fasta_kmers(spark, o.rrna, o.kmer), o.kmer, o.least_hits, ROW).count()}
        modules.write_contamination(o.output, modules.sample_name(path), counts)


def run_rna(spark: SparkSession, o: argparse.Namespace) -> None:
    transcripts = _kept(sources.load_annotation(spark, o.annotation))
    one = annotation.pick_isoforms(transcripts, o.isoform)
    exons = _kept(annotation.spliced_offsets(annotation.exon_rows(one.drop("total_length", "tx_start", "tx_end", "five_prime_end", "three_prime_end"))))
    index = _kept(annotation.feature_index(transcripts))
    genes = one.select("gene_id", F.col("total_length").alias("gene_length"))
    how = profiles.ThreePrime()
    for path in o.inputs:
        sample = modules.sample_name(path)
        at = f"{o.output}.{sample}"
        records = _kept(sources.read_bam(spark, path))
        passed = rna.passing(records, o.mapq)
        percentiles, three = (_kept(x) for x in rna.gene_bins(rna.read_blocks(passed, []), exons, how.bin_size, how.max_3p_dist, 1_024))
        table = profiles.gene_table(genes, percentiles, three, o.min_support, how)
        write_table(profiles.gene_body(genes, percentiles, o.min_support), f"{at}.geneBodyCoverage.txt", ["bin"])
        write_table(profiles.three_prime_profile(table, three, how), f"{at}.3p_anchor_normalized.tsv", ["bin"])
        strata = profiles.stratified_gene_body(genes, percentiles, o.min_support)
        support = genes.join(percentiles.groupBy("gene_id").agg(F.sum("bases").alias("total")).filter(F.col("total") >= o.min_support), "gene_id").groupBy(G.length_class("gene_length").alias("class")).agg(F.count(F.lit(1)).alias("support"))
        modules.write_stratified_gene_body(f"{at}.geneBodyCoverage.stratified.tsv", sample, strata, support)
        modules.write_stratified_three_prime(f"{at}.3p_anchor_normalized.stratified.tsv", sample, profiles.stratified_three_prime(genes, percentiles, three, o.min_support, how), how.bin_size)
        rdna = sources.read_bed(spark, o.rdna_bed) if o.rdna_bed else None
        counters = rna.counters(passed, rdna, ROW, tuple(o.rdna_contigs)).first().asDict()
        distances = rna.inner_distances(rna.first_pairs(rna.mate_pairs(passed, ROW), o.pairs, ["qname", "pair_no"]), exons)
        pairs = rna.pair_summary(distances).first().asDict()
        modules.write_rna_qc(f"{at}.rna_qc.txt", counters, pairs, o.pairs)
        classes = dict(rna.classify_reads(passed, index, ROW, 1_024).groupBy("label").count().collect())
        middle = passed.select(G.normalize_chrom("contig").alias("chrom"), F.explode(G.aligned_blocks("cigar", "pos0")).alias("b")).select("chrom", G.midpoint("b.start", "b.end").alias("p0")).withColumn("p1", F.col("p0") + 1)
        tags = dict(range_join(middle, index.withColumnsRenamed({"start": "f0", "end": "f1"}), "chrom", ("p0", "p1"), ("f0", "f1"), 1_024).groupBy("region").count().collect())
        tags["Intergenic"] = middle.count() - sum(tags.values())
        sizes = dict(annotation.feature_sizes(index).collect())
        loaded = {"transcripts": transcripts.count(), "genes": genes.count()}
        modules.write_read_distribution(f"{at}.read_distribution.txt", loaded, classes, sizes, tags, passed.count())
        found = _kept(rna.classify_junctions(rna.junctions(passed), annotation.introns(annotation.exon_rows(transcripts))))
        modules.write_junctions(o.output, sample, found, rna.junction_saturation(found))
        novelty = {r.novelty: (r.junctions, r.reads) for r in rna.junction_metrics(found).collect()}
        active = table.filter(F.col("total") >= o.min_support).count()
        modules.write_rna_sample(
            f"{at}.rna_summary.json", sample, counters, pairs, classes, tags, novelty, total_reads=records.count(), active_genes=active, active_3p_genes=table.filter("skip_reason is null").count(),
            requested_pairs=o.pairs, distribution_transcripts_loaded=loaded["transcripts"], distribution_genes_loaded=loaded["genes"], distribution_biotypes_included="all",
        )


def run_snapshot(spark: SparkSession, o: argparse.Namespace) -> None:
    transcripts = sources.load_annotation(spark, o.annotation) if o.annotation else None
    markers = sources.read_markers(spark, o.markers) if o.markers else None
    picture = snapshot.snapshot(sources.read_bam(spark, o.inputs), transcripts, markers, o.region, o.most_reads)
    with open(f"{o.output}.svg", "w") as out:
        out.write(picture)


def run_report(spark: SparkSession, o: argparse.Namespace) -> None:
    report.write_report(o.inputs, o.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="helixgrid", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, **options) -> None:
        p = subs.add_parser(name)
        p.add_argument("inputs", nargs="+")
        p.add_argument("--output", "-o", default="helixgrid")
        for key, default in options.items():
            kind = {"action": "store_true"} if default is False else {"nargs": "*", "default": default} if isinstance(default, list) else {"default": default, "type": type(default) if default is not None else str}
            p.add_argument("--" + key.replace("_", "-"), **kind)
        p.set_defaults(run=run)

    add("fastq", run_fastq, mate=None, offset=33, sample=1_000_000, kmer=7, top=20, length_bin=1_000)
    add("align", run_align, mapq=10, read_qc=False)
    add("dna", run_dna, mapq=10, window=100_000, targets=None, reference=None)
    add("contam", run_contam, mapq=10, rdna_bed=None, rdna_contigs=[], rrna=None, kmer=31, least_hits=2, screen="low_mapq")
    add("rna", run_rna, annotation=None, isoform="longest", mapq=10, min_support=100, rdna_bed=None, rdna_contigs=[], pairs=1_000_000)
    add("snapshot", run_snapshot, region=None, annotation=None, markers=None, most_reads=500)
    add("report", run_report)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(arguments)
    o.run(spark or SparkSession.builder.appName("helixgrid").getOrCreate(), o)
