"""Files of each module, and operators that only they use."""

import json

from helixgrid.operators import alignment, contamination, rna, snapshot
from helixgrid.sinks import modules as M
from helixgrid.sources import read_fasta

RECORDS = [
    ("a", 99, "chr1", 10, 60, "5S20M", 150, 0.01, "C" * 25, [30] * 25, "10A9"), ("a", 147, "chr1", 60, 60, "20M", -150, 0.02, "C" * 20, [20] * 20, "20"),
    ("b", 4, None, None, None, "*", 0, None, "ACGT", [2] * 4, None), ("c", 16, "chr2", 5, 3, "5M5X10M", 0, None, "G" * 20, [40] * 20, None),
]
SCHEMA = "qname string, flag int, contig string, pos0 long, mapq int, cigar string, tlen int, de double, seq string, qual array<int>, md string"


def lines(path):
    return [x.split("\t") for x in open(path).read().splitlines()]


def test_fastq_files(spark, tmp_path):
    reads = spark.createDataFrame([(0, i, 1, f"r{i}", s, [40] * len(s)) for i, s in enumerate(["ACGTNN", "ACGTAA", "ACGTAA"])], "file_idx int, rec_no long, mate int, name string, seq string, qual array<int>")
    M.write_fastq(f"{tmp_path}/x", reads, bin_size=5, k=3)
    got = dict(lines(f"{tmp_path}/x.fastq.summary.txt"))
    assert got["total_reads"] == "3" and got["mean_read_length"] == "6.00" and got["read_n50"] == "6" and got["duplication_estimate"] == "0.333333" and got["n_containing_reads"] == "1"
    assert lines(f"{tmp_path}/x.fastq.per_base.tsv")[1] == ["1", "3", "40.000", "3", "0", "0", "0", "0", "100.000", "0.000", "0.000", "0.000", "0.000"]
    assert lines(f"{tmp_path}/x.fastq.length_bins.tsv")[1:] == [["5", "10", "3", "18", "18"]]
    assert lines(f"{tmp_path}/x.fastq.overrepresented.tsv") == [["sequence", "count"], ["ACGTAA", "2"], ["ACGTNN", "1"]]
    said = json.load(open(f"{tmp_path}/x.fastq.summary.json"))
    assert said["module"] == "fastq" and said["metrics"]["length_hist"] == {"6": 3}


def test_align_files(spark, tmp_path):
    records = spark.createDataFrame(RECORDS, SCHEMA)
    M.write_align(f"{tmp_path}/x", records, 10, read_qc=True)
    got = dict(lines(f"{tmp_path}/x.align.summary.txt"))
    assert got["total_records"] == "4" and got["mapq_filtered_records_lt_10"] == "1" and got["soft_clipped_bases"] == "5" and got["total_query_bases"] == "65" and got["de_accuracy_records"] == "2" and got["de_accuracy_mean"] == "0.985000"
    assert lines(f"{tmp_path}/x.align.cigar.tsv") == [["operation", "bases"], ["M", "55"], ["S", "5"], ["X", "5"]]
    assert ["chr2", "1", "1", "1", "20"] in lines(f"{tmp_path}/x.align.contigs.tsv")
    assert lines(f"{tmp_path}/x.align.read_qc.substitutions.tsv")[1:] == [["A->C", "1"]]
    cycles = {(r[0], r[1]): r for r in lines(f"{tmp_path}/x.align.read_qc.cycles.tsv")[1:]}
    assert cycles["read1", "16"][-1] == cycles["read1", "6"][-1] == "0.500000" and cycles["read2", "6"][-1] == "0.000000"
    assert {(r.mate, r.cycle) for r in alignment.mismatch_cycles(records).collect()} == {(1, 15), *((1, c) for c in range(5, 10))}


def test_dna_files(spark, tmp_path):
    records = spark.createDataFrame(RECORDS, SCHEMA)
    contigs = spark.createDataFrame([("chr1", 100), ("chr2", 50)], "contig string, length long")
    ref = spark.createDataFrame([("chr1", 0, "GC" * 20), ("chr1", 40, "AT" * 30), ("chr2", 0, "N" * 50)], "contig string, start long, seq string")
    targets = spark.createDataFrame([("chr1", 0, 20, "t")], "contig string, start long, end long, name string")
    M.write_dna(f"{tmp_path}/x", records, contigs, window=40, targets=targets, target_bed="t.bed", reference=ref)
    got = dict(lines(f"{tmp_path}/x.dna.summary.tsv"))
    assert got["total_records"] == "4" and got["total_aligned_bases"] == "60" and got["total_reference_bases"] == "150" and got["breadth_1x"] == "40.0000" and got["target_bed"] == "t.bed"
    assert lines(f"{tmp_path}/x.dna.depth_hist.tsv")[1:] == [["0", "90", "0.60000000"], ["1", "60", "0.40000000"]]
    assert lines(f"{tmp_path}/x.dna.targets.tsv")[1][:8] == ["chr1", "0", "20", "t", "10", "10", "0.500000", "50.0000"]
    assert [r[:3] for r in lines(f"{tmp_path}/x.dna.windows.tsv")[1:]] == [["chr1", "0", "40"], ["chr1", "40", "80"], ["chr1", "80", "100"], ["chr2", "0", "40"], ["chr2", "40", "50"]]
    bias = {r[0]: r[1] for r in lines(f"{tmp_path}/x.dna.gc_bias.tsv")[1:]}
    assert len(bias) == 101 and bias["1.00"] == "1" and bias["0.00"] == "2"


def test_contamination_and_rna_files(spark, tmp_path):
    M.write_contamination(f"{tmp_path}/x", "s", {"total_reads": 8, "mtdna_reads": 2, "rrna_kmer_reads": 1, "rrna_kmer_reads_screened": 4})
    assert dict(lines(f"{tmp_path}/x.s.contam.summary.tsv"))["mtdna_fraction"] == "0.250000" and json.load(open(f"{tmp_path}/x.s.contam.summary.json"))["sample"] == "s"
    pairs = {"pairs": 2, "fr": 1, "rf": 0, "other": 1, "label": "mixed (geom)", "mean_distance": 1.5, "median_distance": None, "stranded_forward": 1, "stranded_reverse": 1}
    counters = {"aligned_qc_reads": 10, "mtdna_reads": 1, "rdna_reads": 0}
    M.write_rna_qc(f"{tmp_path}/q.tsv", counters, pairs)
    got = lines(f"{tmp_path}/q.tsv")
    assert len(got) == 17 and ["mtdna_fraction", "0.1000"] in got and ["inner_distance_median", "NA"] in got and ["inner_distance_mean", "1.5000"] in got
    M.write_read_distribution(f"{tmp_path}/d.txt", {"transcripts": 3}, {"Exons": 2, "Intergenic": 1}, {"CDS_Exons": 500}, {"CDS_Exons": 4, "Intergenic": 1}, 9)
    text = open(f"{tmp_path}/d.txt").read().splitlines()
    assert text[3].split() == ["distribution_total_classified_reads", "3"] and ["CDS_Exons", "500", "4", "8.00"] in [x.split() for x in text] and ["Total", "Assigned", "Tags", "4"] in [x.split() for x in text]
    out = M.write_rna_sample(f"{tmp_path}/r.json", "s", counters, pairs, {"Exons": 2}, {"CDS_Exons": 4, "Introns": 1}, {"Known": (2, 9)}, total_reads=10)
    assert list(out) == M.RNA_FIELDS and len(out) == 35 and out["exonic_reads"] == 4 and out["unique_known_junctions"] == 2 and out["total_novel_junction_reads"] == 0
    j = spark.createDataFrame([("1", 10, 110, "+", "Known", 3), ("1", 5, 110, "+", "Novel", 1)], "chrom string, start long, end long, strand string, novelty string, reads long")
    M.write_junctions(f"{tmp_path}/x", "s", j, spark.createDataFrame([("Known", 10, 0), ("Known", 20, 1)], "novelty string, percent int, junctions long"))
    assert lines(f"{tmp_path}/x.s.splice_junctions.tsv")[1] == ["1", "5", "110", "+", "Novel", "1"] and lines(f"{tmp_path}/x.s.junction_saturation.tsv")[1:] == [["10%", "0", "0", "0"], ["20%", "1", "0", "0"]]
    M.write_snapshot_manifest(f"{tmp_path}/m.tsv", [("g", "chr1", 9, 20, "+", "p.svg", "top"), ("h", None, None, None, None, None, "not found")])
    assert lines(f"{tmp_path}/m.tsv")[1:] == [["g", "chr1", "10", "20", "+", "p.svg", "top"], ["h", "", "", "", "", "", "not found"]]


def test_names_and_counts():
    assert [M.sample_name(x) for x in ("/a/b.fastq.gz", "c.fq", "d.bam", "e")] == ["b", "c", "d", "e"]
    assert M.safe_label("a/b c") == "a_b_c" and M.module_counts([{"module": "dna"}, {"module": "dna"}, {}]) == {"dna": 2, "unknown": 1}


def test_kmers_across_fasta_windows(spark, tmp_path):
    seq = "ACGTTGCAACGGATCCATTGACCTGAGTCA" * 3
    open(f"{tmp_path}/r.fa", "w").write(">1\n" + seq[:50] + "\n" + seq[50:] + "\n>2\nACGTACGTAC\n")
    flip = str.maketrans("ACGT", "TGCA")
    one = {s[i : i + 10] for s in (seq, "ACGTACGTAC") for i in range(len(s) - 9)}
    assert {r[0] for r in contamination.fasta_kmers(spark, f"{tmp_path}/r.fa", 10, window=20).collect()} == one | {k[::-1].translate(flip) for k in one}
    assert "".join(r.seq for r in read_fasta(spark, f"{tmp_path}/r.fa", 20).filter("chrom = '1'").orderBy("start").collect()) == seq


def test_mismatches_of_a_region(spark):
    records = spark.createDataFrame([("r", 0, 10, "2S4M1D3M", "TTACGTAAA")], "qname string, flag int, pos0 long, cigar string, seq string")
    got = snapshot.segments(records, 8, 18, "NNACCTNANA").first().segments
    assert [(s.start, s.end) for s in got if s.kind == "mismatch"] == [(12, 13)]
    assert [(r.op, r.ref, r.bases) for r in snapshot.query_bases(records).collect()] == [("S", 10, "TT")]


def test_counters_without_intervals(spark):
    records = spark.createDataFrame([("a", "chrM"), ("b", "chr1"), ("c", "U13369.1")], "qname string, contig string")
    assert tuple(rna.counters(records, None, ["qname"], ("U13369.1",)).first()) == (3, 1, 1)
