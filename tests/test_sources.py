import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from helixgrid import sources
from helixgrid.sinks import report, text
from helixgrid.sources.annotation import find_gene, genes_in_region
from helixgrid.sources.bam import bam_contigs
from helixgrid.sources.sequences import fasta_ranges
from helixgrid.streaming import incremental


def fastq(names, seq="ACGT", qual="IIII"):
    return "".join(f"@{n}\r\n{seq}\r\n+\r\n{qual}\r\n" for n in names).encode()


def test_fastq_gzip_members_pairs_and_errors(spark, tmp_path):
    a, b, c, bad = (f"{tmp_path}/{n}" for n in ("a.fastq.gz", "b.fastq", "c.fastq", "bad.fastq"))
    open(a, "wb").write(gzip.compress(fastq(["x/1", "y/1"])) + gzip.compress(fastq(["z/1"])))
    open(b, "wb").write(fastq(["x/2", "q/2", "z/2"]))
    open(c, "wb").write(fastq(["x/2"]))
    open(bad, "wb").write(b"@x\nACGT\n+\n")
    rows = sources.read_fastq(spark, [a, b]).orderBy("file_idx", "rec_no").collect()
    assert [(r.file_idx, r.rec_no, r.name, r.seq, r.qual) for r in rows][:3] == [(0, i, n, "ACGT", [40] * 4) for i, n in enumerate(["x/1", "y/1", "z/1"])] and len(rows) == 6
    from helixgrid.operators.fastq import name_mismatches

    assert tuple(name_mismatches(sources.read_paired_fastq(spark, a, b)).first()) == (3, 1)
    with pytest.raises(Exception, match="record counts"):
        sources.read_paired_fastq(spark, a, c).collect()
    with pytest.raises(Exception, match="cut off"):
        sources.read_fastq(spark, bad).collect()


def test_fasta_windows_and_ranges(spark, tmp_path):
    seq = "ACGTTGCAAC" * 10
    open(f"{tmp_path}/r.fa", "w").write(">chr1 text\n" + "\n".join(seq[i : i + 7] for i in range(0, 100, 7)) + "\n>2\nGG\n")
    fa = sources.read_fasta(spark, f"{tmp_path}/r.fa", window=16)
    assert fa.count() == 8
    want = spark.createDataFrame([("1", 10, 60), ("CHR2", 0, 2)], "chrom string, start long, end long")
    assert {r.chrom: r.seq for r in fasta_ranges(fa, want, 16).collect()} == {"1": seq[10:60], "CHR2": "GG"}


GTF = [
    ("exon", 101, 200, 'gene_id "g1"; transcript_id "t1"; gene_name "ABC"; transcript_biotype "protein_coding"; tag "basic"; tag "Ensembl_canonical"; tag "appris_principal_2"; transcript_support_level "1 (x)";'),
    ("exon", 301, 400, 'gene_id "g1"; transcript_id "t1";'), ("CDS", 121, 350, 'gene_id "g1"; transcript_id "t1";'),
    ("gene", 1, 999, 'gene_id "g1"'), ("exon", 50, 60, "transcript_id=t2;gene_id=g2"),
]


def test_gtf_equals_bed12(spark, tmp_path):
    lines = "".join(f"chr1\tx\t{f}\t{a}\t{b}\t.\t+\t.\t{attr}\n" for f, a, b, attr in GTF).encode()
    open(f"{tmp_path}/a.gtf.gz", "wb").write(gzip.compress(b"#head\n" + lines[:150]) + gzip.compress(lines[150:]))
    open(f"{tmp_path}/a.bed", "w").write("chr1\t100\t400\tg1|t1\t0\t+\t120\t350\t0\t2\t100,100,\t0,200,\n")
    gtf = {r.transcript_id: r for r in sources.load_annotation(spark, f"{tmp_path}/a.gtf.gz").collect()}
    bed = sources.load_annotation(spark, f"{tmp_path}/a.bed", gene_id_delimiter="|").first()
    t = gtf["t1"]
    assert t.exons == bed.exons and (t.cds_start, t.cds_end) == (bed.cds_start, bed.cds_end) == (120, 350) and bed.gene_id == t.gene_id == "g1"
    assert (t.ensembl_canonical, t.appris, t.tsl, t.gene_name, t.biotype) == (True, 2, 1, "ABC", "protein_coding") and gtf["t2"].gene_id == "g2"
    df = sources.read_gtf(spark, f"{tmp_path}/a.gtf.gz")
    assert tuple(find_gene(df, "abc").select("chrom", "start", "end").first()) == ("chr1", 100, 400)
    assert [(e.start, e.end) for e in genes_in_region(df, "1", 150, 310).first().exons] == [(150, 200), (300, 310)]
    df.write.parquet(f"{tmp_path}/saved.parquet")
    assert sources.load_annotation(spark, f"{tmp_path}/saved.parquet").count() == 2
    with pytest.raises(ValueError, match="format"):
        sources.load_annotation(spark, "x.txt")


def test_bed_targets_and_markers(spark, tmp_path):
    open(f"{tmp_path}/t.bed", "w").write("track x\n#c\nchr1\t5\t9\tn\nchr1\t1\t3\nchr2\t4\t4\n")
    assert sorted(tuple(r) for r in sources.read_targets(spark, f"{tmp_path}/t.bed").collect()) == [("chr1", 1, 3, "chr1:1-3"), ("chr1", 5, 9, "n")]
    open(f"{tmp_path}/m.tsv", "w").write("chrom\tpos\tlabel\ttype\tend\nchr1\t7\ta\tsv\t12\nchr1\t8\tb\n")
    assert [tuple(r) for r in sources.read_markers(spark, f"{tmp_path}/m.tsv").orderBy("pos").collect()] == [("chr1", 7, "a", "sv", 12), ("chr1", 8, "b", "variant", None)]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bam_record(name, flag, ref, pos, mapq, cigar, seq, qual, tags):
    n = name.encode() + b"\0"
    codes = ["=ACMGRSVTWYHKDBN".index(b) for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    ops = b"".join(struct.pack("<I", k << 4 | "MIDNSHP=X".index(o)) for k, o in cigar)
    d = struct.pack("<iiBBHHHiiii", ref, pos, len(n), mapq, 0, len(cigar), flag, len(seq), -1, -1, 7) + n + ops + packed + bytes(qual) + tags
    return struct.pack("<i", len(d)) + d


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + n + struct.pack("<i", k) for n, k in ((b"chr1\0", 1000), (b"chr2\0", 50)))
    tags = b"deC\x01" + b"MDZ3A1\0" + b"HPi" + struct.pack("<i", 2) + b"XXBs" + struct.pack("<ihh", 2, 1, 2)
    recs = [bam_record(f"r{i}", 0, 0, i * 10, 60 if i else 255, [(5, "M")], "ACGTN", [30] * 5, tags) for i in range(50)] + [bam_record("u", 4, -1, -1, 0, [], "", [], b"")]
    data, path = head + b"".join(recs), f"{tmp_path}/a.bam"
    open(path, "wb").write(b"".join(block(data[i : i + 333]) for i in range(0, len(data), 333)) + block(b""))
    rows = sources.read_bam(spark, path).orderBy("rec_no").collect()
    assert len(rows) == 51 and (rows[1].qname, rows[1].contig, rows[1].pos0, rows[1].cigar, rows[1].seq, rows[1].qual, rows[1].de, rows[1].md, rows[1].hp) == ("r1", "chr1", 10, "5M", "ACGTN", [30] * 5, 1.0, "3A1", 2)
    assert rows[0].mapq is None and rows[50].contig is None and rows[50].seq == ""
    assert [tuple(r) for r in bam_contigs(spark, path).collect()] == [("chr1", 1000), ("chr2", 50)]
    # an index with one bin that spans the file
    end = len(b"".join(block(data[i : i + 333]) for i in range(0, len(data), 333))) << 16
    open(path + ".bai", "wb").write(b"BAI\1" + struct.pack("<i", 1) + struct.pack("<iIi", 1, 4681, 1) + struct.pack("<QQ", (len(block(data[:333])) * (len(head) // 333)) << 16 | len(head) % 333, end) + struct.pack("<i", 1) + struct.pack("<Q", 0))
    got = sources.read_bam(spark, path, ("chr1", 95, 305), window=100)
    assert sorted(r.pos0 for r in got.collect()) == list(range(100, 305, 10)) and got.rdd.getNumPartitions() == 3
    with pytest.raises(ValueError, match="CRAM"):
        sources.read_bam(spark, "x.cram")


def test_text_sinks_and_report(spark, tmp_path):
    df = spark.createDataFrame([(2, 5), (1, None)], "depth int, count long")
    text.write_table(df, f"{tmp_path}/h.tsv", ["depth"])
    assert open(f"{tmp_path}/h.tsv").read() == "depth\tcount\n1\tNA\n2\t5\n"
    text.write_metrics(spark.sql("select 1 as a, 0.5D as b"), f"{tmp_path}/m.tsv")
    assert open(f"{tmp_path}/m.tsv").read() == "metric\tvalue\na\t1\nb\t0.500000\n"
    wide = text.wide_by_sample(spark.createDataFrame([("s1", 0, 3), ("s2", 1, 4)], "sample string, bin int, v int"), "bin", "v", ["s1", "s2"])
    assert [tuple(r) for r in wide.collect()] == [(0, 3, 0), (1, 0, 4)]
    text.write_summary(f"{tmp_path}/a.dna.summary.json", "dna", "s<1>", {"mean": 1.5, "kmers": [1], "deep": {"overrepresented_x": 1, "ok": None}})
    open(f"{tmp_path}/b.contamination.json", "w").write(json.dumps({"total": 3}))
    as_json, as_html = report.write_report([str(tmp_path), f"{tmp_path}/a"], f"{tmp_path}/out")
    docs = json.loads(as_json.read_text())["documents"]
    assert [(d["module"], d["sample"]) for d in docs] == [("dna", "s<1>"), ("contamination", "b")] and docs[0]["metrics"] == {"mean": 1.5, "deep": {"ok": None}}
    assert "s&lt;1&gt;" in as_html.read_text()


def test_streaming_histogram(spark, tmp_path):
    df = spark.createDataFrame([(0, "c", 5), (4, "c", None), (0, "d", 5)], "flag int, contig string, mapq int")
    df.write.parquet(f"{tmp_path}/in")
    stream = incremental.arriving(spark, f"{tmp_path}/in", df.schema)
    for i in range(2):
        incremental.run(incremental.mapq_histogram(stream), f"hist{i}", f"{tmp_path}/cp").awaitTermination()
        assert {r.mapq: r["count"] for r in spark.table(f"hist{i}").collect()} == {5: 2 + 2 * i, 255: 1 + i}
        df.write.mode("append").parquet(f"{tmp_path}/in")
