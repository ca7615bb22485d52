"""The command line, from files to files."""

import json
import struct

from helixgrid import commands

from .test_sources import GTF, bam_record, block, fastq


def lines(path):
    return [x.split("\t") for x in open(path).read().splitlines()]


def bam(path, name=b"chr1\0"):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", len(name)) + name + struct.pack("<i", 2000)
    tags = b"MDZ3A1\0"
    recs = [bam_record(f"r{i}", 0 if i % 2 else 16, 0, 100 + i * 10, 60, [(5, "M")], "ACGTN", [30] * 5, tags) for i in range(20)]
    recs += [bam_record(f"j{i}", 0, 0, 190, 60, [(10, "M"), (100, "N"), (10, "M")], "A" * 20, [30] * 20, b"") for i in range(3)] + [bam_record("u", 4, -1, -1, 0, [], "", [], b"")]
    data = head + b"".join(recs)
    open(path, "wb").write(b"".join(block(data[i : i + 333]) for i in range(0, len(data), 333)) + block(b""))


def test_reads_and_alignments(spark, tmp_path):
    open(f"{tmp_path}/a.fastq", "wb").write(fastq(["x/1", "y/1"]))
    open(f"{tmp_path}/b.fastq", "wb").write(fastq(["x/2", "q/2"]))
    commands.main(["fastq", f"{tmp_path}/a.fastq", "--mate", f"{tmp_path}/b.fastq", "-o", f"{tmp_path}/o"], spark)
    got = dict(lines(f"{tmp_path}/o.fastq.summary.txt"))
    assert got["total_reads"] == "4" and got["paired_reads_checked"] == "2" and got["paired_name_mismatches"] == "1"
    bam(f"{tmp_path}/s.bam")
    commands.main(["align", f"{tmp_path}/s.bam", "-o", f"{tmp_path}/o"], spark)
    assert dict(lines(f"{tmp_path}/o.align.summary.txt"))["total_records"] == "24"
    open(f"{tmp_path}/t.bed", "w").write("chr1\t100\t200\n")
    open(f"{tmp_path}/r.fa", "w").write(">chr1\n" + "GATC" * 500 + "\n")
    commands.main(["dna", f"{tmp_path}/s.bam", "-o", f"{tmp_path}/o", "--window", "500", "--targets", f"{tmp_path}/t.bed", "--reference", f"{tmp_path}/r.fa"], spark)
    assert lines(f"{tmp_path}/o.dna.targets.tsv")[1][3] == "chr1:100-200" and len(lines(f"{tmp_path}/o.dna.windows.tsv")) == 5
    assert [r for r in lines(f"{tmp_path}/o.dna.gc_bias.tsv") if r[0] == "0.50"][0][1] == "4"
    open(f"{tmp_path}/k.fa", "w").write(">r\nACGTNAAAAAAAAAAAAAAAA\n")
    commands.main(["contam", f"{tmp_path}/s.bam", "-o", f"{tmp_path}/o", "--rdna-bed", f"{tmp_path}/t.bed", "--rrna", f"{tmp_path}/k.fa", "--kmer", "8", "--screen", "all"], spark)
    got = dict(lines(f"{tmp_path}/o.s.contam.summary.tsv"))
    assert got["total_reads"] == "24" and got["mapped_reads"] == "23" and got["rdna_interval_reads"] == "13" and got["rrna_kmer_reads"] == "3" and got["rrna_kmer_reads_screened"] == "24"


def test_rna(spark, tmp_path):
    bam(f"{tmp_path}/s.bam")
    open(f"{tmp_path}/a.gtf", "w").write("".join(f"chr1\tx\t{f}\t{a}\t{b}\t.\t+\t.\t{attr}\n" for f, a, b, attr in GTF))
    commands.main(["rna", f"{tmp_path}/s.bam", "-o", f"{tmp_path}/o", "--annotation", f"{tmp_path}/a.gtf", "--min-support", "1"], spark)
    said = json.load(open(f"{tmp_path}/o.s.rna_summary.json"))
    assert said["total_reads"] == 24 and said["aligned_qc_reads"] == 23 and said["unique_known_junctions"] == 1 and said["total_known_junction_reads"] == 3
    assert lines(f"{tmp_path}/o.s.splice_junctions.tsv")[1] == ["1", "200", "300", "+", "Known", "3"]
    assert said["exonic_reads"] + said["intronic_reads"] + said["flanking_reads"] + said["intergenic_reads"] == 26
    assert ["aligned_qc_reads", "23"] in lines(f"{tmp_path}/o.s.rna_qc.txt") and len(lines(f"{tmp_path}/o.s.geneBodyCoverage.txt")) == 101
    commands.main(["snapshot", f"{tmp_path}/s.bam", "-o", f"{tmp_path}/o", "--region", "chr1:90-400", "--annotation", f"{tmp_path}/a.gtf"], spark)
    assert open(f"{tmp_path}/o.svg").read().startswith("<svg")
