"""Scalar functions on alignments, reads and names, as column expressions."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of an alignment's flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, FIRST, LAST = 1, 2, 4, 8, 16, 64, 128
SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 256, 512, 1024, 2048

#: Adapter starts. Results are counted per adapter.
ADAPTERS = (
    "AGATCGGAAGAGC",
    "CTGTCTCTTATACACATCT",
    "AAGTCGGAGGCCAAGCGGTCTTAGGAAGACAA",
    "AATGATACGGCGACCACCGAGATCTACAC",
)
#: Names of the mitochondrial contig. Fixed values; RNA metrics and contamination use different sets.
RNA_MITO = ("m", "mt", "chrm", "chrmt")
CONTAM_MITO = ("m", "mt", "mitochondria")

#: Bases of a read whose k-mers are cut from one piece.
PIECE = 128

_OPS = "array<struct<len:int,op:string>>"
_SPANS = "array<struct<start:bigint,end:bigint>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_ascii(c: Column | str) -> Column:
    """A-Z only: other letters keep their length, so positions stay true."""
    return F.translate(_col(c), string.ascii_lowercase, string.ascii_uppercase)


def flag_is(flag: Column | str, bits: int) -> Column:
    """Any of the bits is set."""
    return _col(flag).bitwiseAND(F.lit(bits)) != 0


def normalize_chrom(c: Column | str) -> Column:
    """Lower case, without a leading `chr`."""
    return F.regexp_replace(F.lower(_col(c)), "^chr", "")


def is_autosome(c: Column | str) -> Column:
    return normalize_chrom(c).rlike("^0*([1-9]|1[0-9]|2[0-2])$")


def cigar_ops(cigar: Column | str) -> Column:
    """array of (len, op)."""
    found = F.regexp_extract_all(_col(cigar), F.lit(r"\d+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.substr(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def _walk(ops: Column, start: Column, emits: str) -> Column:
    """Reference spans of the operations in `emits`, in order."""
    zero = F.struct(start.cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        moves = x["op"].isin(*"MDN=X")
        end = s["at"] + x["len"]
        span = F.array(F.struct(s["at"].alias("start"), end.alias("end")))
        return F.struct(F.when(moves, end).otherwise(s["at"]).alias("at"), F.when(x["op"].isin(*emits), F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.aggregate(ops, zero, step, lambda s: s["out"])


def aligned_blocks(cigar: Column | str, pos0: Column | str) -> Column:
    """Spans of M, = and X, each operation its own; D and N advance."""
    return _walk(cigar_ops(cigar), _col(pos0), "M=X")


def introns(cigar: Column | str, pos0: Column | str) -> Column:
    """Spans of N: the junctions of a read."""
    return _walk(cigar_ops(cigar), _col(pos0), "N")


def op_length(cigar: Column | str, ops: str) -> Column:
    """Summed length of some operations."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: x["op"].isin(*ops)), F.lit(0).cast("bigint"), lambda s, x: s + x["len"])


def reference_span(cigar: Column | str) -> Column:
    return op_length(cigar, "MDN=X")


def aligned_length(cigar: Column | str) -> Column:
    return op_length(cigar, "MD=X")


def match_span(cigar: Column | str, pos0: Column | str) -> Column:
    """(start of the first block, end of the last), null without blocks."""
    b = aligned_blocks(cigar, pos0)
    return F.when(F.size(b) > 0, F.struct(F.element_at(b, 1)["start"].alias("start"), F.element_at(b, -1)["end"].alias("end")))


def midpoint(start: Column | str, end: Column | str) -> Column:
    s, e = _col(start), _col(end)
    return s + F.floor((e - s) / 2).cast("bigint")


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(upper_ascii(seq)), "ACGTU", "TGCAA")


def base_class(base: Column | str) -> Column:
    b = upper_ascii(base)
    return F.when(b == "U", "T").when(b.isin(*"ACGT"), b).otherwise("N")


def gc_percent(seq: Column | str) -> Column:
    """floor(100 * GC / length), 0 for an empty read."""
    s = _col(seq)
    gc = F.length(s) - F.length(F.translate(s, "GCgc", ""))
    return F.when(F.length(s) > 0, F.floor(100 * gc / F.length(s))).otherwise(F.lit(0)).cast("int")


def phred(qual: Column | str, offset: int = 33) -> Column:
    """array<int> of a quality string; below the offset is 0."""
    return F.transform(F.filter(F.split(_col(qual), ""), lambda q: q != ""), lambda q: F.greatest(F.ascii(q) - offset, F.lit(0)))


def mean_quality(quals: Column | str) -> Column:
    """floor(sum / length) of an array of qualities, 0 if empty."""
    q = _col(quals)
    total = F.aggregate(q, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return F.when(F.size(q) > 0, F.floor(total / F.size(q))).otherwise(F.lit(0)).cast("int")


def poly_tail(seq: Column | str, base: str, least: int = 12) -> Column:
    return upper_ascii(seq).rlike(rf"{base}{{{least}}}\z")


def adapter_start(seq: Column | str, adapter: str) -> Column:
    """0-based start of the first hit, -1 without."""
    return F.locate(adapter, upper_ascii(seq)) - 1


def kmers(seq: Column | str, k: int) -> Column:
    """All upper-case k-mers of A, C, G and T, repeats included.

    A substring is sought from its text's beginning, so a long read is cut into pieces that overlap by k - 1 first; and
    the read is a lambda's argument, so its letters are folded once.
    """

    def pieces(s: Column) -> Column:
        starts = F.when(F.length(s) >= k, F.sequence(F.lit(0), F.length(s) - k, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(s, i + 1, F.lit(PIECE + k - 1)))

    cut = F.flatten(F.transform(F.array(upper_ascii(seq)), pieces))
    every = F.flatten(F.transform(cut, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substr(p, i, F.lit(k)))))
    return F.filter(every, lambda x: F.length(F.translate(x, "ACGT", "")) == 0)


def read_name(name: Column | str) -> Column:
    """Without leading @, the comment, and a closing /1 or /2."""
    return F.regexp_replace(F.regexp_extract(_col(name), r"^@*\s*(\S+)", 1), r"(/2)*(/1)*$", "")


def name_hash(name: Column | str) -> Column:
    """The first 32 bits of the MD5 digest: the same in every engine."""
    return F.conv(F.substring(F.md5(_col(name)), 1, 8), 16, 10).cast("bigint")


def hash_bucket(name: Column | str, n: int = 100) -> Column:
    return F.pmod(name_hash(name), F.lit(n)).cast("int")


def fraction(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))


def percent(a: Column | str, b: Column | str) -> Column:
    return 100 * fraction(a, b)


def accuracy(de: Column | str) -> Column:
    return F.least(F.greatest(1 - _col(de), F.lit(0.0)), F.lit(1.0))


def accuracy_bin(de: Column | str) -> Column:
    return F.floor(accuracy(de) * 10_000 + 0.5).cast("int")


def md_elements(md: Column | str) -> Column:
    """Numbers, deletions and mismatches of an MD tag, in order."""
    return F.regexp_extract_all(_col(md), F.lit(r"(\d+|\^[A-Za-z]+|[A-Za-z])"), F.lit(1))


def appris_level(attributes: Column | str) -> Column:
    return F.try_element_at(F.regexp_extract_all(_col(attributes), F.lit(r"appris_principal_([1-5])"), F.lit(1)), F.lit(1)).cast("int")


def gtf_attribute(attributes: Column | str, key: str) -> Column:
    """Value of a `key "value"` or `key=value` attribute, null if absent."""
    got = F.regexp_extract(_col(attributes), rf'(?:^|;)\s*{key}[ =]\s*"?([^";]*)', 1)
    return F.when(got != "", F.trim(got))


def support_level(attributes: Column | str) -> Column:
    value = F.coalesce(gtf_attribute(attributes, "transcript_support_level"), gtf_attribute(attributes, "tsl"))
    return F.regexp_extract(value, r"^(\d)", 1).try_cast("int")


def length_stratum(length: Column | str) -> Column:
    n = _col(length)
    return F.when(n < 2_000, "all").when(n < 5_000, "2-5kb").when(n < 10_000, "5-10kb").when(n < 20_000, "10-20kb").otherwise("20kb+")


#: Length classes of the stratified gene body: (label, lower bound). Fixed values.
LENGTH_CLASSES = (("short (<1.5kb)", 0), ("medium (1.5-5kb)", 1_500), ("long (5-10kb)", 5_001), ("very long (>10kb)", 10_001))


def length_class(length: Column | str) -> Column:
    out = F.lit(LENGTH_CLASSES[0][0])
    return reduce(lambda acc, x: F.when(_col(length) >= x[1], x[0]).otherwise(acc), LENGTH_CLASSES[1:], out)


def strandedness(forward: Column | str, reverse: Column | str, fr: Column | str, rf: Column | str, pairs: Column | str) -> Column:
    """Label of a library: by annotation from 100 stranded pairs on, else by geometry."""
    f, r, total = _col(forward), _col(reverse), _col(forward) + _col(reverse)
    by_shape = F.when(_col(pairs) == 0, "undetermined").when(fraction(fr, pairs) >= 0.8, "FR (geom)").when(fraction(rf, pairs) >= 0.8, "RF (geom)").otherwise("mixed (geom)")
    by_gene = F.when(fraction(f, total) >= 0.8, "FR (stranded-forward)").when(fraction(r, total) >= 0.8, "RF (stranded-reverse)").otherwise("unstranded/mixed")
    return F.when(total < 100, by_shape).otherwise(by_gene)
