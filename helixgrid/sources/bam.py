"""BAM as a DataFrame, by a Python data source.

A BAM file is a chain of BGZF blocks. One partition reads one file as a stream; with an index beside it (.bai) and a
region, only the chunks that the index names for the region are read, one partition per window of the region.
CRAM is refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from helixgrid.shipping import ship

#: Fixed values of the format: operation and base codes.
CIGAR_CODES = "MIDNSHP=X"
BASE_CODES = "=ACMGRSVTWYHKDBN"
SCHEMA = "file_idx int, rec_no long, qname string, flag int, contig string, pos0 long, mapq int, cigar string, tlen int, seq string, qual array<int>, de double, md string, hp int"

_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_KINDS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


def _open(path: str):
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(where)


class Bgzf:
    """Uncompressed bytes from a virtual offset on."""

    def __init__(self, stream, offset: int = 0) -> None:
        self.stream, self.next, self.data, self.at = stream, offset >> 16, b"", 0
        if self._fill():
            self.at = offset & 0xFFFF

    def _fill(self) -> bool:
        self.stream.seek(self.next)
        head = self.stream.read(18)
        if len(head) < 18:
            return False
        if head[:4] != b"\x1f\x8b\x08\x04":
            raise ValueError("not a BGZF block")
        extra = struct.unpack("<H", head[10:12])[0]
        fields = head[12:18] + self.stream.read(max(0, extra - 6))
        size, i = None, 0
        while i + 4 <= extra:
            n = struct.unpack("<H", fields[i + 2 : i + 4])[0]
            if fields[i : i + 2] == b"BC":
                size = struct.unpack("<H", fields[i + 4 : i + 6])[0] + 1
            i += 4 + n
        if size is None:
            raise ValueError("a BGZF block without its size")
        body = self.stream.read(size - 12 - extra)
        self.start, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        return True

    def read(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n and self._fill():
            more = self.data[: n - len(out)]
            self.at = len(more)
            out += more
        return out

    def tell(self) -> int:
        return self.next << 16 if self.at >= len(self.data) else self.start << 16 | self.at


def read_header(b: Bgzf) -> list[tuple[str, int]]:
    if b.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    b.read(struct.unpack("<i", b.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", b.read(4))[0]):
        name = b.read(struct.unpack("<i", b.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", b.read(4))[0]))
    return out


def parse_tags(data: bytes) -> dict[str, object]:
    out, i = {}, 0
    while i + 3 <= len(data):
        tag, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in "ZH":
            end = data.index(b"\0", i)
            out[tag], i = data[i:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[i]), struct.unpack("<i", data[i + 1 : i + 5])[0]
            i += 5 + n * _SIZES[sub]
        elif kind == "A":
            out[tag], i = chr(data[i]), i + 1
        else:
            out[tag] = struct.unpack(_KINDS[kind], data[i : i + _SIZES[kind]])[0]
            i += _SIZES[kind]
    return out


def parse_record(data: bytes, refs: list[tuple[str, int]]) -> tuple:
    """The columns from qname on."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, _, _, tlen = struct.unpack("<iiBBHHHiiii", data[:32])
    i = 32
    name = data[i : i + l_name - 1].decode()
    i += l_name
    ops = struct.unpack(f"<{n_cigar}I", data[i : i + 4 * n_cigar])
    i += 4 * n_cigar
    packed = data[i : i + (l_seq + 1) // 2]
    i += (l_seq + 1) // 2
    seq = "".join(BASE_CODES[x >> 4] + BASE_CODES[x & 15] for x in packed)[:l_seq]
    qual = data[i : i + l_seq]
    tags = parse_tags(data[i + l_seq :])
    number = lambda k: tags[k] if isinstance(tags.get(k), (int, float)) else None
    return (
        name, flag, refs[ref][0] if 0 <= ref < len(refs) else None, pos, None if mapq == 255 else mapq, "".join(f"{o >> 4}{CIGAR_CODES[o & 15]}" for o in ops), tlen, seq,
        [] if qual[:1] == b"\xff" else list(qual), None if number("de") is None else float(number("de")), tags.get("MD"), None if number("HP") is None else int(number("HP")),
    )


def records(b: Bgzf, refs: list[tuple[str, int]], end: int | None = None) -> Iterator[tuple]:
    while end is None or b.tell() < end:
        size = b.read(4)
        if len(size) < 4:
            return
        yield parse_record(b.read(struct.unpack("<i", size)[0]), refs)


def index_chunks(bai: bytes, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """Merged virtual offset ranges that the index names for a region."""
    i = 8
    wanted = {0} | {base + k for shift, base in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for k in range(start >> shift, (end - 1 >> shift) + 1)}
    found, least = [], 0
    for r in range(struct.unpack("<i", bai[4:8])[0]):
        n_bin = struct.unpack("<i", bai[i : i + 4])[0]
        i += 4
        for _ in range(n_bin):
            number, n = struct.unpack("<Ii", bai[i : i + 8])
            i += 8
            if r == ref and number in wanted:
                found += [struct.unpack("<QQ", bai[i + 16 * k : i + 16 * k + 16]) for k in range(n)]
            i += 16 * n
        n_intv = struct.unpack("<i", bai[i : i + 4])[0]
        i += 4
        if r == ref:
            least = struct.unpack("<Q", bai[i + 8 * (start >> 14) : i + 8 * (start >> 14) + 8])[0] if start >> 14 < n_intv else 0
        i += 8 * n_intv
    merged: list[list[int]] = []
    for a, z in sorted(c for c in found if c[1] > least):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], z)
        else:
            merged.append([a, z])
    return [(a, z) for a, z in merged]


class _Part(InputPartition):
    def __init__(self, path: str, index: int, region: tuple[str, int, int] | None) -> None:
        self.path, self.index, self.region = path, index, region


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["paths"].split("\n")
        self.region = options.get("region")
        self.window = int(options.get("window", 10_000_000))

    def partitions(self) -> list[InputPartition]:
        if not self.region:
            return [_Part(p, i, None) for i, p in enumerate(self.paths)]
        name, start, end = self.region.split("\t")
        cuts = range(int(start), int(end), self.window)
        return [_Part(p, i, (name, a, min(a + self.window, int(end)))) for i, p in enumerate(self.paths) for a in cuts]

    def read(self, partition: _Part):
        with _open(partition.path) as stream:
            b = Bgzf(stream)
            refs = read_header(b)
            if partition.region is None:
                for n, r in enumerate(records(b, refs)):
                    yield partition.index, n, *r
                return
            name, start, end = partition.region
            with _open(partition.path + ".bai") as f:
                bai = f.read()
            ref = [x for x, _ in refs].index(name)
            for a, z in index_chunks(bai, ref, start, end):
                for r in records(Bgzf(stream, a), refs, z):
                    if r[2] == name and start <= r[3] < end:  # a window owns the records that start in it
                        yield partition.index, None, *r


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helixgrid_bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, paths: str | list[str], region: tuple[str, int, int] | None = None, window: int = 10_000_000) -> DataFrame:
    """The records of BAM files; with a region (contig, start, end), those that start in it, by the index beside each file."""
    every = [paths] if isinstance(paths, str) else list(paths)
    if any(p.lower().endswith(".cram") for p in every):
        raise ValueError("CRAM is not supported; convert it to BAM")
    ship(spark)
    spark.dataSource.register(BamSource)
    reader = spark.read.format(BamSource.name()).option("paths", "\n".join(every)).option("window", window)
    return (reader.option("region", "\t".join(map(str, region))) if region else reader).load()


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, length from the header."""
    with _open(path) as stream:
        refs = read_header(Bgzf(stream))
    return spark.createDataFrame(refs, "contig string, length long").select("contig", F.col("length").cast("long").alias("length"))
