"""Metrics of raw reads. Reads: file_idx, rec_no, mate, name, seq, qual (array of int)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.functions import genomics as G
from helixgrid.shipping import ship

#: Records of a file that are counted together when the first reads are sought, as a power of 2.
TILE_BITS = 12
#: Letters whose k-mers are counted at once.
BLOCK = 1 << 20
#: Bytes to 0..3 for A, C, G and T of either case, 4 for all others.
LETTERS = np.full(256, 4, np.uint8)
for _at, _letter in enumerate(b"ACGT"):
    LETTERS[[_letter, _letter + 32]] = _at


def summary(reads: DataFrame) -> DataFrame:
    n = F.length("seq")
    return reads.agg(
        F.count(F.lit(1)).alias("total_reads"), F.coalesce(F.sum(n.cast("bigint")), F.lit(0)).alias("total_bases"), F.min(n).alias("min_len"), F.max(n).alias("max_len"),
        F.coalesce(F.try_divide(F.sum(n), F.count(F.lit(1))), F.lit(0.0)).alias("mean_len"),
        F.count_if(G.poly_tail("seq", "A")).alias("poly_a"), F.count_if(G.poly_tail("seq", "G")).alias("poly_g"),
        F.count_if(F.length(F.translate("seq", "ACGTUacgtu", "")) > 0).alias("n_reads"),
    )


def length_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(F.length("seq").alias("length")).agg(F.count(F.lit(1)).alias("count"))


def gc_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(G.gc_percent("seq").alias("gc")).agg(F.count(F.lit(1)).alias("count"))


def quality_histogram(reads: DataFrame) -> DataFrame:
    return reads.groupBy(G.mean_quality("qual").alias("mean_quality")).agg(F.count(F.lit(1)).alias("count"))


def per_position(reads: DataFrame) -> DataFrame:
    """Coverage, base classes and quality sum of each position."""
    bases = reads.select("qual", F.posexplode(F.filter(F.split("seq", ""), lambda b: b != "")).alias("position", "base"))
    kind = G.base_class("base")
    return bases.groupBy("position").agg(F.count(F.lit(1)).alias("reads"), F.sum(F.coalesce(F.try_element_at("qual", F.col("position") + 1), F.lit(0)).cast("bigint")).alias("quality_sum"), *[F.count_if(kind == b).alias(f"n_{b.lower()}") for b in "ACGTN"])


def position_qualities(reads: DataFrame) -> DataFrame:
    return reads.select(F.posexplode("qual").alias("position", "quality")).groupBy("position", "quality").agg(F.count(F.lit(1)).alias("count"))


def adapters(reads: DataFrame, adapters: tuple[str, ...] = G.ADAPTERS) -> DataFrame:
    """Hits of each adapter by the position of the first one in a read."""
    found = F.filter(F.array(*[F.struct(F.lit(a).alias("adapter"), G.adapter_start("seq", a).alias("position")) for a in adapters]), lambda x: x["position"] >= 0)
    return reads.select(F.explode(found).alias("x")).groupBy("x.adapter", "x.position").agg(F.count(F.lit(1)).alias("count"))


def sample(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads in input order, mates of a pair counting each.

    Reads are counted by tiles of record numbers. Those of the tiles before the one that the n-th read lies in stay
    where they are; only that tile is sorted.
    """
    if n <= 0:
        return reads.limit(0)
    tile = F.struct(F.coalesce(F.col("file_idx").cast("bigint"), F.lit(-1)).alias("file"), F.coalesce(F.shiftright(F.col("rec_no").cast("bigint"), TILE_BITS), F.lit(-(1 << 63))).alias("at"))
    tiled = reads.withColumn("_tile", tile)
    along = Window.partitionBy(F.lit(0)).orderBy("_tile").rowsBetween(Window.unboundedPreceding, 0)  # a row for each tile
    counts = tiled.groupBy("_tile").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(along))
    over = counts.filter(F.col("_upto") > n).agg(F.min(F.struct(F.col("_tile").alias("tile"), (n - F.col("_upto") + F.col("_n")).alias("rest"))).alias("_edge"))
    whole = tiled.crossJoin(F.broadcast(over)).filter("_edge is null or _tile < _edge.tile")
    # no row where all reads are wanted
    edge = over.filter("_edge is not null").select(F.col("_edge.tile").alias("_tile"), F.col("_edge.rest").alias("_rest"))
    ranked = tiled.join(F.broadcast(edge), "_tile").withColumn("_rank", F.row_number().over(Window.partitionBy("_tile").orderBy("rec_no", "mate")))
    return whole.select(*reads.columns).unionByName(ranked.filter("_rank <= _rest").select(*reads.columns))


def duplication(sampled: DataFrame) -> DataFrame:
    """1 - distinct / sampled, by the sequence as it is written."""
    return sampled.agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("seq").alias("distinct_reads")).withColumn("duplication", F.when(F.col("sampled") > 0, 1 - F.try_divide("distinct_reads", "sampled")).otherwise(0.0))


def overrepresented(sampled: DataFrame, n: int) -> DataFrame:
    """The n most common sequences; ties by sequence."""
    return sampled.groupBy("seq").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "seq").limit(n)


def kmer_counts(sampled: DataFrame, k: int) -> DataFrame:
    """How often each upper-case k-mer of A, C, G and T occurs. Up to 31 letters are packed two bits each."""
    if not 1 <= k <= 31:
        return sampled.select(F.explode(G.kmers("seq", k)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("count"))
    ship(sampled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int64) if k <= 10 else None
        for batch in batches:
            for codes in packed_kmers(batch.column(0), k):
                if total is not None:
                    total += np.bincount(codes.astype(np.int64), minlength=len(total))
                else:
                    yield _spelled(*np.unique(codes, return_counts=True), k)
        if total is not None:
            found = np.flatnonzero(total)
            yield _spelled(found.astype(np.uint64), total[found], k)

    return sampled.select("seq").mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("count"))


def packed_kmers(seqs: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The k-mers of texts, two bits a letter, the first letter highest; at most BLOCK at a time."""
    seqs = seqs.cast(pa.large_string())
    ends = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(seqs) else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    for lo in range(0, len(data) - k + 1, BLOCK):
        letter = LETTERS[data[lo : lo + BLOCK + k - 1]]
        m = len(letter) - k + 1
        other = np.append(0, np.cumsum(letter > 3, dtype=np.int32))
        good = other[k:] == other[:m]
        borders = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + len(letter), "left")] - lo
        for before in range(1, k):  # these would go on in the next text
            at = borders - before
            good[at[(at >= 0) & (at < m)]] = False
        codes = np.zeros(m, np.uint32 if k <= 15 else np.uint64)
        for i in range(k):
            codes = (codes << codes.dtype.type(2)) | (letter[i : i + m] & 3)
        yield codes[good]


def _spelled(codes: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
    shifts = np.arange(2 * (k - 1), -1, -2).astype(np.uint64)
    letters = np.frombuffer(b"ACGT", np.uint8)[((codes.astype(np.uint64)[:, None] >> shifts) & np.uint64(3)).astype(np.int64)]
    offsets = np.arange(0, (len(codes) + 1) * k, k, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))), pa.array(n.astype(np.int64))], ["kmer", "n"])


def nx(lengths: DataFrame) -> DataFrame:
    """For x = 5, 10 .. 100 the length at which the longest reads hold x % of all bases. lengths: length, count."""
    one = Window.partitionBy(F.lit(0))  # a histogram: as many rows as there are lengths
    cum = lengths.filter("length > 0").withColumn("b", F.col("length").cast("bigint") * F.col("count")).withColumn("cum", F.sum("b").over(one.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("b").over(one))
    levels = cum.withColumn("x", F.explode(F.sequence(F.lit(5), F.lit(100), F.lit(5))))
    return levels.filter("cum * 100 >= total * x").groupBy("x").agg(F.max("length").alias("length"))


def length_bins(lengths: DataFrame, size: int) -> DataFrame:
    """Reads and bases by length bin, and the bases of reads at least that long."""
    bins = lengths.groupBy((F.floor(F.col("length") / size) * size).cast("bigint").alias("bin_start")).agg(F.sum("count").alias("reads"), F.sum(F.col("count") * F.col("length")).alias("bases"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("bin_start")).rowsBetween(Window.unboundedPreceding, 0)
    return bins.select("bin_start", (F.col("bin_start") + size).alias("bin_end"), "reads", "bases", F.sum("bases").over(w).alias("cumulative_bases_ge_start"))


def pair(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mates by record number; fails where one side has no partner."""
    a = first.select(F.col("rec_no"), F.struct(*first.columns).alias("r1"))
    b = second.select(F.col("rec_no"), F.struct(*second.columns).alias("r2"))
    both = a.join(b, "rec_no", "full")
    ok = F.when(F.col("r1").isNull() | F.col("r2").isNull(), F.raise_error(F.lit("paired FASTQ files have different record counts")).cast("boolean")).otherwise(True)
    return both.filter(ok)


def name_mismatches(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(G.read_name("r1.name") != G.read_name("r2.name")).alias("mismatches"))
