"""FASTQ and FASTA as DataFrames.

Both are line formats whose records span lines; a line's number within its file is what groups them. Files are read as
whole-file partitions of a Python data source that streams gzip (also of several members) or plain text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from helixgrid.operators.fastq import pair
from helixgrid.shipping import ship

CHUNK = 1 << 20


def open_store(path: str):
    """A readable stream of a path that the executors share; with a scheme, by that store."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_stream(where, compression=None)


def lines(path: str) -> Iterator[bytes]:
    """Lines without CR and LF; gzip by suffix, with any number of members."""
    with open_store(path) as stream:
        rest, z = b"", zlib.decompressobj(31) if path.endswith(".gz") else None
        while data := stream.read(CHUNK):
            if z is not None:
                out = b""
                while data:
                    out += z.decompress(data)
                    data = z.unused_data
                    if z.eof:
                        z = zlib.decompressobj(31)
                data = out
            *full, rest = (rest + data).split(b"\n")
            yield from (x.rstrip(b"\r") for x in full)
        if rest:
            yield rest.rstrip(b"\r")


class _File(InputPartition):
    def __init__(self, path: str, index: int) -> None:
        self.path, self.index = path, index


class _Files(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = options["paths"].split("\n")

    def partitions(self) -> list[InputPartition]:
        return [_File(p, i) for i, p in enumerate(self.paths)]


class _FastqReader(_Files):
    def read(self, partition: _File):
        source, n = lines(partition.path), 0
        for head in source:
            if not head:
                continue
            seq, plus, qual = next(source, None), next(source, None), next(source, None)
            if qual is None:
                raise ValueError(f"{partition.path}: record {n} is cut off")
            if not head.startswith(b"@") or not plus.startswith(b"+"):
                raise ValueError(f"{partition.path}: record {n} has no @ or +")
            yield partition.index, n, head[1:].decode(), seq.decode(), qual.decode()
            n += 1


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helixgrid_fastq"

    def schema(self) -> str:
        return "file_idx int, rec_no long, name string, seq string, qual_text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FastqReader(self.options)


class _FastaReader(_Files):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.window, self.overlap = int(options["window"]), int(options.get("overlap", 0))

    def read(self, partition: _File):
        name, held, at = None, b"", 0
        for line in lines(partition.path):
            if line.startswith(b">"):
                if len(held) > (self.overlap if at else 0):
                    yield name, at, held.decode()
                name, held, at = line[1:].split(None, 1)[0].decode() if line[1:].strip() else "", b"", 0
                continue
            held += line.strip()
            while len(held) >= self.window + self.overlap:
                yield name, at, held[: self.window + self.overlap].decode()
                held, at = held[self.window :], at + self.window
        if len(held) > (self.overlap if at else 0):
            yield name, at, held.decode()


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "helixgrid_fasta"

    def schema(self) -> str:
        return "chrom string, start long, seq string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FastaReader(self.options)


def _load(spark: SparkSession, source: type[DataSource], paths: str | list[str], **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("paths", "\n".join([paths] if isinstance(paths, str) else paths)).options(**options).load()


def read_fastq(spark: SparkSession, paths: str | list[str], offset: int = 33, mate: int = 1) -> DataFrame:
    """file_idx, rec_no, mate, name, seq, qual (array of int)."""
    from helixgrid.functions.genomics import phred

    rows = _load(spark, FastqSource, paths)
    return rows.select("file_idx", "rec_no", F.lit(mate).alias("mate"), "name", "seq", phred("qual_text", offset).alias("qual"))


def read_paired_fastq(spark: SparkSession, first: str, second: str, offset: int = 33) -> DataFrame:
    """rec_no, r1, r2; fails if one file has more records."""
    return pair(read_fastq(spark, first, offset, 1), read_fastq(spark, second, offset, 2))


def read_fasta(spark: SparkSession, paths: str | list[str], window: int = 100_000, overlap: int = 0) -> DataFrame:
    """chrom, start, seq in windows of that size: a range is fetched by joining on the window number. A window holds `overlap` bases of the next one, too."""
    return _load(spark, FastaSource, paths, window=window, overlap=overlap)


def fasta_ranges(fasta: DataFrame, ranges: DataFrame, window: int = 100_000) -> DataFrame:
    """ranges (chrom, start, end and others) with `seq`; names match with or without chr."""
    bare = lambda c: F.regexp_replace(F.lower(F.trim(c)), "^chr", "")
    keyed = ranges.withColumn("_id", F.struct(*ranges.columns)).withColumn("_w", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor((F.col("end") - 1) / window))))
    pieces = fasta.select(bare(F.col("chrom")).alias("_c"), F.floor(F.col("start") / window).alias("_fw"), F.col("start").alias("_at"), F.col("seq").alias("_piece"))
    met = keyed.join(pieces, (bare(F.col("chrom")) == F.col("_c")) & (F.col("_w") == F.col("_fw")))
    part = F.substr("_piece", (F.greatest(F.col("start") - F.col("_at"), F.lit(0)) + 1).cast("int"), (F.least(F.col("end") - F.col("_at"), F.lit(window)) - F.greatest(F.col("start") - F.col("_at"), F.lit(0))).cast("int"))
    joined = met.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_at", part.alias("p")))).alias("ps"))  # the windows of one range
    return joined.select("_id.*", F.concat_ws("", F.transform("ps", lambda x: x["p"])).alias("seq"))
