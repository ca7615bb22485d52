"""Files of each module: what its operators give, written under a prefix.

A sheet is a TSV of one DataFrame; its rows are streamed to the file in order, so a long one (windows, junctions) is
never held whole. A listing is a few named values. File names, titles and decimals are what readers of these files
expect: fixed values, as is the order of the metrics.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.operators import alignment, dna, fastq
from helixgrid.operators.annotation import REGIONS
from helixgrid.operators.intervals import histogram_quantile, windows
from helixgrid.sinks.text import envelope, histogram_json

SUFFIXES = (".gz", ".fastq", ".fq", ".bam", ".cram")


def sample_name(path: str) -> str:
    """A file's name without folders and the suffixes of reads and alignments, in that order."""
    name = re.split(r"[/\\]", path)[-1]
    for s in SUFFIXES:
        while name.endswith(s):
            name = name[: -len(s)]
    return name


def shown(value: object, spec: str = "") -> str:
    return "NA" if value is None else format(value, spec)


def sheet(path: str, titles: str, df: DataFrame, cells: str, order: Sequence[str] = ()) -> None:
    """cells: names of columns, each with its format after a colon, separated by spaces."""
    fields = [c.partition(":")[::2] for c in cells.split()]
    rows = df.orderBy(*order) if order else df
    with open(path, "w") as out:
        out.write("\t".join(titles.split()) + "\n")
        for row in rows.select(*dict.fromkeys(f for f, _ in fields)).toLocalIterator(prefetchPartitions=True):
            out.write("\t".join(shown(row[f], spec) for f, spec in fields) + "\n")


def listing(path: str, values: Iterable[tuple[str, object]], header: bool = False, specs: dict[str, str] | None = None) -> None:
    lines = [f"{k}\t{shown(v, (specs or {}).get(k, ''))}" for k, v in values]
    Path(path).write_text("\n".join((["metric\tvalue"] if header else []) + lines) + "\n")


def _json(path: str, value: object) -> None:
    Path(path).write_text(json.dumps(value, indent=2, default=str))


def write_fastq(prefix: str, reads: DataFrame, pairs: DataFrame | None = None, sample: int = 1_000_000, k: int = 7, top: int = 20, bin_size: int = 1_000, adapters: tuple[str, ...] = G.ADAPTERS) -> dict:
    """Summary, positions, histograms, length bins, common sequences and k-mers of reads; returns the metrics. pairs: see fastq.pair()."""
    at = f"{prefix}.fastq"
    lengths = fastq.length_histogram(reads)
    first = fastq.sample(reads, sample)
    total, twice = fastq.summary(reads).first(), fastq.duplication(first).first()
    nx = {r.x: r.length for r in fastq.nx(lengths).collect()}
    checked = fastq.name_mismatches(pairs).first() if pairs is not None else None
    hits = {r[0]: r[1] for r in fastq.adapters(reads, adapters).groupBy("adapter").agg(F.sum("count")).orderBy("adapter").collect()}
    values = [
        ("total_reads", total.total_reads), ("total_bases", total.total_bases), ("min_read_length", total.min_len or 0), ("mean_read_length", total.mean_len), ("max_read_length", total.max_len or 0),
        *((f"read_n{x}", nx[x]) for x in sorted(nx)), ("duplication_estimate", twice.duplication), ("sampled_reads_for_duplicates", twice.sampled),
        ("poly_a_reads", total.poly_a), ("poly_g_reads", total.poly_g), ("n_containing_reads", total.n_reads),
        ("paired_reads_checked", checked.pairs if checked else 0), ("paired_name_mismatches", checked.mismatches if checked else 0), *((f"adapter_hit:{a}", n) for a, n in hits.items()),
    ]
    listing(f"{at}.summary.txt", values, specs={"mean_read_length": ".2f", "duplication_estimate": ".6f"})
    share = [(100 * F.col(f"n_{b}") / F.greatest("reads", F.lit(1))).alias(f"{b}_pct") for b in "acgtn"]
    places = fastq.per_position(reads).select((F.col("position") + 1).alias("position"), "reads", (F.col("quality_sum") / F.greatest("reads", F.lit(1))).alias("q"), *[f"n_{b}" for b in "acgtn"], *share)
    sheet(f"{at}.per_base.tsv", "position count mean_quality A C G T N A_pct C_pct G_pct T_pct N_pct", places, "position reads q:.3f n_a n_c n_g n_t n_n a_pct:.3f c_pct:.3f g_pct:.3f t_pct:.3f n_pct:.3f", ["position"])
    gc, quality = fastq.gc_histogram(reads), fastq.quality_histogram(reads)
    sheet(f"{at}.length_distribution.tsv", "length reads", lengths, "length count", ["length"])
    sheet(f"{at}.gc_distribution.tsv", "gc_percent reads", gc, "gc count", ["gc"])
    sheet(f"{at}.mean_quality_distribution.tsv", "mean_quality reads", quality, "mean_quality count", ["mean_quality"])
    sheet(f"{at}.length_bins.tsv", "bin_start bin_end reads bases cumulative_bases_ge_start", fastq.length_bins(lengths, bin_size), "bin_start bin_end reads bases cumulative_bases_ge_start", ["bin_start"])
    kmers = fastq.kmer_counts(first, k).orderBy(F.desc("count"), "kmer").limit(top)
    common = fastq.overrepresented(first, top)
    sheet(f"{at}.overrepresented.tsv", "sequence count", common, "seq count", [F.desc("count"), "seq"])
    sheet(f"{at}.kmers.tsv", "kmer count", kmers, "kmer count", [F.desc("count"), "kmer"])
    metrics = {
        "total_reads": total.total_reads, "total_bases": total.total_bases, "min_len": total.min_len or 0, "max_len": total.max_len or 0, "mean_read_length": total.mean_len, "read_nx": {str(x): nx[x] for x in sorted(nx)},
        "length_hist": histogram_json(lengths, "length"), "gc_hist": histogram_json(gc, "gc"), "mean_quality_hist": histogram_json(quality, "mean_quality"), "adapter_hits": hits,
        "duplicate_sample_reads": twice.sampled, "duplicate_sample_unique": twice.distinct_reads, "duplication_estimate": twice.duplication, "poly_a_reads": total.poly_a, "poly_g_reads": total.poly_g, "n_reads": total.n_reads,
        "paired_reads_checked": checked.pairs if checked else 0, "paired_name_mismatches": checked.mismatches if checked else 0,
        "overrepresented": [{"sequence": r.seq, "count": r["count"]} for r in common.collect()], "kmers": [{"kmer": r.kmer, "count": r["count"]} for r in kmers.collect()],
    }
    _json(f"{at}.summary.json", envelope("fastq", prefix, metrics))
    return metrics


def write_align(prefix: str, records: DataFrame, mapq: int = 10, read_qc: bool = False) -> dict:
    """Counts, histograms, CIGAR bases, contigs, accuracy and insert metrics of alignment records; with read_qc, which needs seq, qual and md, cycles and substitutions."""
    at = f"{prefix}.align"
    flags, low = alignment.flagstat(records).first(), alignment.low_mapq(records, mapq).first()
    totals = {r.op: r.bases for r in alignment.cigar_totals(records).orderBy("op").collect()}
    hist = alignment.accuracy_histogram(records)
    accuracy = alignment.accuracy_summary(records).first()
    quantile = {q: (lambda r: r.quantile / 10_000 if r and r.quantile is not None else None)(histogram_quantile(hist, q, "bin").first()) for q in (0.05, 0.95)}
    taken = lambda ops: sum(totals.get(o, 0) for o in ops)
    metrics = {
        "total_records": flags.total, "mapped_records": flags.mapped, "unmapped_records": flags.unmapped, "primary_records": flags.primary, "secondary_records": flags.secondary, "supplementary_records": flags.supplementary,
        "duplicate_records": flags.duplicates, "qc_fail_records": flags.qc_fail, "paired_records": flags.paired, "properly_paired_records": flags.proper, "singleton_records": flags.singleton,
        "discordant_records": flags.discordant, "orphan_records": flags.orphan, "mapq_filtered_records": low.low_mapq, "total_query_bases": taken("MIS=X"), "total_aligned_match_bases": taken("M=X"),
        "soft_clipped_bases": taken("S"), "hard_clipped_bases": taken("H"),
    }
    values = [(f"mapq_filtered_records_lt_{mapq}" if k == "mapq_filtered_records" else k, v) for k, v in metrics.items()]
    values += [("de_accuracy_records", accuracy.n), ("de_accuracy_mean", accuracy["mean"]), ("de_accuracy_median", accuracy.median), ("de_accuracy_mode", accuracy["mode"]), ("de_accuracy_p05", quantile[0.05]), ("de_accuracy_p95", quantile[0.95])]
    listing(f"{at}.summary.txt", values, specs=dict.fromkeys(("de_accuracy_mean", "de_accuracy_median", "de_accuracy_mode", "de_accuracy_p05", "de_accuracy_p95"), ".6f"))
    by_mapq, inserts = alignment.mapq_histogram(records), alignment.insert_histogram(records)
    by_length = records.groupBy(G.op_length("cigar", "MIS=X").alias("n")).agg(F.count(F.lit(1)).alias("count"))
    contigs = alignment.contig_counts(records)
    sheet(f"{at}.mapq.tsv", "mapq records", by_mapq, "mapq count", ["mapq"])
    sheet(f"{at}.read_length.tsv", "read_length records", by_length, "n count", ["n"])
    sheet(f"{at}.insert_size.tsv", "insert_size records", inserts, "insert_size count", ["insert_size"])
    Path(f"{at}.cigar.tsv").write_text("operation\tbases\n" + "".join(f"{o}\t{n}\n" for o, n in totals.items()))
    sheet(f"{at}.contigs.tsv", "contig records mapped_records primary_mapped_records bases", contigs, "contig records mapped primary_mapped reference_bases", ["contig"])
    shares = hist.select((F.col("bin") / 10_000).alias("a"), (1 - F.col("bin") / 10_000).alias("de"), "count", (F.col("count") / max(1, accuracy.n)).alias("share"))
    sheet(f"{at}.de_accuracy.tsv", "accuracy_bin de_bin records fraction", shares, "a:.4f de:.4f count share:.8f", ["a"])
    found = alignment.insert_metrics(inserts).first()
    if found is not None:
        names = "total_inserts mono_nucleosomal_peak di_nucleosomal_peak mono_nucleosomal_count di_nucleosomal_count sub_nucleosomal_count short_cfdna_count mono_cfdna_count cfdna_ratio mono_di_ratio short_fraction mono_fraction di_fraction large_fragment_count".split()
        listing(f"{at}.insert_size_metrics.tsv", [(x, found[x]) for x in names], header=True, specs=dict.fromkeys((x for x in names if x.endswith(("ratio", "fraction"))), ".6f"))
        metrics["insert_size_metrics"] = found.asDict()
    if read_qc:
        cycles = alignment.cycle_rates(records)
        share = [(100 * F.col(f"n_{b}") / F.col("reads")).alias(f"{b}_pct") for b in "acgtn"]
        rows = cycles.select(F.concat(F.lit("read"), F.col("mate").cast("string")).alias("read"), (F.col("cycle") + 1).alias("cycle"), "reads", (F.col("quality_sum") / F.col("reads")).alias("q"), *share, "mismatch_rate")
        sheet(f"{at}.read_qc.cycles.tsv", "read_type cycle base_count mean_quality A_pct C_pct G_pct T_pct N_pct mismatch_rate", rows, "read cycle reads q:.4f a_pct:.4f c_pct:.4f g_pct:.4f t_pct:.4f n_pct:.4f mismatch_rate:.6f", ["read", "cycle"])
        swaps = alignment.md_substitutions(records).groupBy(F.concat("ref", F.lit("->"), "query").alias("swap")).agg(F.count(F.lit(1)).alias("count"))
        sheet(f"{at}.read_qc.substitutions.tsv", "substitution count", swaps, "swap count", ["swap"])
        sheet(f"{at}.read_qc.qualities.tsv", "quality count", alignment.quality_counts(records), "quality count", ["quality"])
    metrics |= {"mapq_hist": histogram_json(by_mapq, "mapq"), "read_length_hist": histogram_json(by_length, "n"), "insert_size_hist": histogram_json(inserts, "insert_size"), "cigar_op_bases": totals}
    _json(f"{at}.summary.json", envelope("align", prefix, metrics))
    return metrics


_DEPTH_TITLES = "aligned_bases depth_bases mean_depth breadth_1x breadth_5x breadth_10x breadth_20x breadth_30x"
_DEPTH_CELLS = "depth_bases depth_bases mean:.6f pct_1:.4f pct_5:.4f pct_10:.4f pct_20:.4f pct_30:.4f"


def _with_rates(depths: DataFrame, length) -> DataFrame:
    """Mean depth and breadth in percent beside the bases of each level."""
    return depths.select("*", F.coalesce(F.try_divide("depth_bases", length), F.lit(0.0)).alias("mean"), *[F.coalesce(F.try_divide(100 * F.col(f"bases_ge_{n}"), length), F.lit(0.0)).alias(f"pct_{n}") for n in dna.LEVELS])


def write_dna(prefix: str, records: DataFrame, contigs: DataFrame, window: int = 100_000, mapq: int = 0, targets: DataFrame | None = None, target_bed: str | None = None, reference: DataFrame | None = None) -> dict:
    """Depth summary, histogram, contigs, windows, targets (contig, start, end, name) and GC bias (reference: contig, start, seq)."""
    at = f"{prefix}.dna"
    kept = dna.passing(records, mapq)
    segs = dna.segments(records, mapq)
    hist = dna.depth_histogram(segs, contigs)
    total = dna.summary(hist).first()
    mapped = ~G.flag_is("flag", G.UNMAPPED)
    counts = records.agg(F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(mapped & ~G.flag_is("flag", G.SECONDARY | G.SUPPLEMENTARY) & (F.coalesce("mapq", F.lit(255)) < mapq)).alias("low")).first()
    aligned = kept.agg(F.coalesce(F.sum(G.op_length("cigar", "M=X")), F.lit(0)).alias("n")).first().n
    metrics = {"total_records": counts.total, "mapped_records": counts.mapped, "filtered_mapq_records": counts.low, "total_aligned_bases": aligned, "total_reference_bases": total.reference_bases or 0, "mean_depth": total.mean_depth, "median_depth": float(total.median_depth or 0)}
    metrics |= {f"breadth_{n}x": total[f"breadth_{n}"] for n in dna.LEVELS} | {"window_size": window}
    listing(f"{at}.summary.tsv", [*metrics.items(), *([("target_bed", target_bed)] if target_bed else [])], header=True, specs={"mean_depth": ".6f", "median_depth": ".6f"} | {f"breadth_{n}x": ".4f" for n in dna.LEVELS})
    sheet(f"{at}.depth_hist.tsv", "depth bases fraction", hist.withColumn("share", F.col("bases") / max(1, metrics["total_reference_bases"])), "depth bases share:.8f", ["depth"])
    sheet(f"{at}.contigs.tsv", f"chrom length {_DEPTH_TITLES}", _with_rates(dna.contig_depth(segs, contigs), F.col("length")), f"contig length {_DEPTH_CELLS}", ["contig"])
    width = F.greatest(F.col("end") - F.col("start"), F.lit(1))
    tiles = dna.span_depth(segs, windows(contigs, window), window)
    sheet(f"{at}.windows.tsv", f"chrom start end {_DEPTH_TITLES}", _with_rates(tiles, width), f"contig start end {_DEPTH_CELLS}", ["contig", "start"])
    if targets is None:
        Path(f"{at}.targets.tsv").write_text("\t".join(f"chrom start end name {_DEPTH_TITLES}".split()) + "\n")
    else:
        sheet(f"{at}.targets.tsv", f"chrom start end name {_DEPTH_TITLES}", _with_rates(dna.span_depth(segs, targets, window), width), f"contig start end name {_DEPTH_CELLS}", ["contig", "start", "end", "name"])
    if reference is not None:
        bias = dna.gc_bias(dna.window_gc(tiles.withColumn("mean_depth", F.col("depth_bases") / width), reference, window)).withColumn("gc", F.col("gc_percent") / 100)
        sheet(f"{at}.gc_bias.tsv", "gc_fraction window_count mean_depth normalized_coverage standard_error", bias, "gc:.2f window_count mean_depth:.6f normalized_coverage:.6f standard_error:.6f", ["gc_percent"])
        metrics["gc_bias"] = {"bins": [r.asDict() for r in bias.orderBy("gc_percent").collect()]}  # 101 rows
    _json(f"{at}.summary.json", envelope("dna", prefix, metrics | {"depth_hist": histogram_json(hist, "depth", "bases"), "target_bed": target_bed}))
    return metrics


CONTAMINATION = "total_reads mapped_reads mtdna_reads mtdna_fraction rdna_interval_reads rdna_contig_reads rdna_aligned_fraction rrna_kmer_reads rrna_kmer_reads_screened rrna_kmer_fraction".split()


def write_contamination(prefix: str, sample: str, counts: dict) -> None:
    """counts: the values of CONTAMINATION but fractions that can be told from them. The JSON has no envelope."""
    full = {"mtdna_fraction": _share(counts.get("mtdna_reads"), counts.get("total_reads")), "rrna_kmer_fraction": _share(counts.get("rrna_kmer_reads"), counts.get("rrna_kmer_reads_screened"))} | counts
    listing(f"{prefix}.{sample}.contam.summary.tsv", [(k, full.get(k, 0)) for k in CONTAMINATION], header=True, specs=dict.fromkeys((k for k in CONTAMINATION if k.endswith("fraction")), ".6f"))
    _json(f"{prefix}.{sample}.contam.summary.json", {"sample": sample} | {k: full.get(k, 0) for k in CONTAMINATION})


def _share(a: int | None, b: int | None) -> float:
    return a / b if a and b else 0.0


def write_rna_qc(path: str, counters: dict, pairs: dict, requested_pairs: int = 0, evicted: int = 0) -> None:
    """counters: aligned_qc_reads, mtdna_reads, rdna_reads (rna.counters()); pairs: a row of rna.pair_summary()."""
    n, seen = counters["aligned_qc_reads"], pairs.get("pairs") or 0
    values = [
        ("aligned_qc_reads", n), ("mtdna_reads", counters["mtdna_reads"]), ("mtdna_fraction", _share(counters["mtdna_reads"], n)), ("rdna_reads", counters["rdna_reads"]), ("rdna_fraction", _share(counters["rdna_reads"], n)),
        ("requested_pairs", requested_pairs), ("informative_pairs", seen), ("inferred_strandness", pairs.get("label", "undetermined")), ("geometric_fr_fraction", _share(pairs.get("fr"), seen)), ("geometric_rf_fraction", _share(pairs.get("rf"), seen)),
        ("other_orientation_fraction", _share(pairs.get("other"), seen)), ("pending_evictions", evicted), ("inner_distance_mean", pairs.get("mean_distance")), ("inner_distance_median", pairs.get("median_distance")),
        ("stranded_forward_count", pairs.get("stranded_forward") or 0), ("stranded_reverse_count", pairs.get("stranded_reverse") or 0),
    ]
    listing(path, values, header=True, specs=dict.fromkeys(("mtdna_fraction", "rdna_fraction", "geometric_fr_fraction", "geometric_rf_fraction", "other_orientation_fraction", "inner_distance_mean", "inner_distance_median"), ".4f"))


def write_read_distribution(path: str, loaded: dict[str, object], classes: dict[str, int], sizes: dict[str, int], tags: dict[str, int], passed: int) -> None:
    """loaded: transcripts, genes, biotypes; classes: reads by label; sizes and tags: bases and tags by region."""
    groups, rule = (*REGIONS, "Intergenic"), "=" * 69
    head = [
        ("transcripts_loaded", loaded.get("transcripts", 0)), ("genes_loaded", loaded.get("genes", 0)), ("biotypes_included", loaded.get("biotypes", "all")), ("total_classified_reads", sum(classes.values())),
        ("exonic_reads", classes.get("Exons", 0)), ("intronic_reads", classes.get("Introns", 0)), ("flank_reads", classes.get("TSS_up_1kb", 0)), ("intergenic_reads", classes.get("Intergenic", 0)),
    ]
    out = [f"{f'distribution_{k}':<38}{v}" for k, v in head] + [rule]
    out += [f"{k:<30}{v}" for k, v in (("Total Reads", passed), ("Total Tags", sum(tags.values())), ("Total Assigned Tags", sum(n for g, n in tags.items() if g != "Intergenic")))] + [rule]
    out.append("".join(f"{x:<20}" for x in ("Group", "Total_bases", "Tag_count", "Tags/Kb")))
    out += [f"{g:<20}{sizes.get(g, 0):<20}{tags.get(g, 0):<20}{1000 * tags.get(g, 0) / sizes[g] if sizes.get(g) else 0.0:<18.2f}" for g in groups] + [rule]
    Path(path).write_text("\n".join(out) + "\n")


def write_stratified_gene_body(path: str, sample: str, profile: DataFrame, support: DataFrame) -> None:
    """profile: rows of profiles.stratified_gene_body(); support: class, support."""
    rows = profile.join(support, "class").select(F.lit(sample).alias("sample"), "class", (F.col("bin") + 1).alias("percentile"), "mean", "percent", "support")
    sheet(path, "sample stratum percentile mean_coverage mean_percent_coverage support", rows, "sample class percentile mean:.4f percent:.2f support", ["class", "percentile"])


def write_stratified_three_prime(path: str, sample: str, profile: DataFrame, bin_size: int) -> None:
    """profile: rows of profiles.stratified_three_prime()."""
    rows = profile.select(F.lit(sample).alias("sample"), "stratum", (F.col("bin") * bin_size).alias("a"), ((F.col("bin") + 1) * bin_size).alias("z"), "mean", "support")
    sheet(path, "sample stratum distance_start_bp distance_end_bp mean_normalized_coverage support", rows, "sample stratum a z mean:.4f support", ["stratum", "a"])


def write_junctions(prefix: str, sample: str, classified: DataFrame, saturation: DataFrame) -> None:
    """classified: rows of rna.classify_junctions(); saturation: of rna.junction_saturation()."""
    sheet(f"{prefix}.{sample}.splice_junctions.tsv", "chrom start end strand novelty read_support", classified, "chrom start end strand novelty reads", ["chrom", "start", "end", "strand"])
    wide = saturation.groupBy("percent").pivot("novelty", ["Known", "PartialNovel", "Novel"]).agg(F.first("junctions")).na.fill(0).withColumn("at", F.concat(F.col("percent").cast("string"), F.lit("%")))
    sheet(f"{prefix}.{sample}.junction_saturation.tsv", "fraction known partial_novel novel", wide, "at Known PartialNovel Novel", ["percent"])


#: Fields of a sample's JSON, in order.
RNA_FIELDS = """sample total_reads active_genes active_3p_genes aligned_qc_reads mtdna_reads mtdna_fraction rdna_reads rdna_fraction requested_pairs informative_pairs
inferred_strandness fr_count rf_count other_orientation_count inner_distance_mean inner_distance_median exonic_reads intronic_reads flanking_reads intergenic_reads
distribution_transcripts_loaded distribution_genes_loaded distribution_biotypes_included distribution_total_classified_reads distribution_exonic_reads
distribution_intronic_reads distribution_flank_reads distribution_intergenic_reads unique_known_junctions unique_partial_novel_junctions unique_novel_junctions
total_known_junction_reads total_partial_novel_junction_reads total_novel_junction_reads""".split()


def write_rna_sample(path: str, sample: str, counters: dict, pairs: dict, classes: dict[str, int], tags: dict[str, int], junctions: dict[str, tuple[int, int]] | None = None, **more: object) -> dict:
    """All RNA_FIELDS of a sample. junctions: novelty -> (junctions, reads); more: fields by name."""
    n, seen = counters["aligned_qc_reads"], pairs.get("pairs") or 0
    summed = lambda regions: sum(tags.get(r, 0) for r in regions)
    got = {
        "sample": sample, **{k: counters[k] for k in ("aligned_qc_reads", "mtdna_reads", "rdna_reads")}, "mtdna_fraction": _share(counters["mtdna_reads"], n), "rdna_fraction": _share(counters["rdna_reads"], n),
        "informative_pairs": seen, "inferred_strandness": pairs.get("label", "undetermined"), "fr_count": pairs.get("fr") or 0, "rf_count": pairs.get("rf") or 0, "other_orientation_count": pairs.get("other") or 0,
        "inner_distance_mean": pairs.get("mean_distance"), "inner_distance_median": pairs.get("median_distance"),
        "exonic_reads": summed(REGIONS[:4]), "intronic_reads": summed(REGIONS[4:5]), "flanking_reads": summed(REGIONS[5:]), "intergenic_reads": tags.get("Intergenic", 0),
        "distribution_total_classified_reads": sum(classes.values()), "distribution_exonic_reads": classes.get("Exons", 0), "distribution_intronic_reads": classes.get("Introns", 0),
        "distribution_flank_reads": classes.get("TSS_up_1kb", 0), "distribution_intergenic_reads": classes.get("Intergenic", 0),
    }
    for novelty, name in (("Known", "known"), ("PartialNovel", "partial_novel"), ("Novel", "novel")):
        a, b = (None, None) if junctions is None else junctions.get(novelty, (0, 0))
        got |= {f"unique_{name}_junctions": a, f"total_{name}_junction_reads": b}
    out = {k: (got | more).get(k, 0) for k in RNA_FIELDS}
    _json(path, out)
    return out


def safe_label(name: str) -> str:
    """A name that can be a file's: other characters than letters, digits, `-`, `_` and `.` become `_`."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name) or "_"


def write_snapshot_manifest(path: str, rows: Iterable[tuple[str, str | None, int | None, int | None, str | None, str | None, str]]) -> None:
    """rows: gene, chrom, start (0-based), end, strand, picture, reason; of a gene without a region only its name and the reason count."""
    with open(path, "w") as out:
        out.write("gene\tchrom\tstart\tend\tstrand\tsnapshot_path\treason\n")
        for gene, chrom, start, end, strand, picture, reason in rows:
            place = ("", "", "", "", "") if chrom is None else (chrom, str(start + 1), str(end), strand or "", picture or "")
            out.write("\t".join((gene, *place, reason)) + "\n")


def module_counts(summaries: Iterable[dict]) -> dict[str, int]:
    """How many summaries there are of each module."""
    out: dict[str, int] = {}
    for s in summaries:
        out[s.get("module", "unknown")] = out.get(s.get("module", "unknown"), 0) + 1
    return dict(sorted(out.items()))
