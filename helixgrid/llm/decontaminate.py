"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are runs of letters and digits of the text with A-Z lower-cased (bytes beyond ASCII count as letters); a set is
the hashes of a text's distinct 5-word shingles. An item is contained in a document if `percent` of its shingles are
in the document's set.

Documents are partitioned by size: one with at most 2**p shingles is in partition p, whose sketches have 4 * 2**p bins.
A set's sketch keeps the smallest hash of each bin (one-permutation MinHash), so a short item and a document many times
longer still agree in a bin unless a smaller hash of the document fell there, which at a load of 1/4 at most happens to
one shared shingle in eight. Each item is sketched once per partition. A document and an item that share a (partition,
bin, hash) entry are a candidate pair. Items with fewer than `SMALL` shingles, for which that chance is not negligible,
have an entry for every shingle instead, in every partition; no cap applies to candidates.

Documents look their entries up in a bit filter of fixed size that holds all items' entries; only what it passes is
joined, so what is sent to executors doesn't grow. Candidates are verified by the exact number of common shingles.

Defined cases: null and empty texts, and those with fewer than 5 words, contain nothing and are contained in nothing;
documents that repeat an id are searched each and found as one pair per row; items that repeat an id are one item each;
other columns are dropped; with no documents or no items there are no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import cut, prepare, unused
from helixgrid.llm.textkernel import LOWER, PUNCTUATION, blocks, mix, shingles, word_hashes, words

WORDS = 5
PERCENT = 80
SMALL = 16
LEVELS = 34  # partitions: up to 2**34 shingles
FILTER_BITS = 27  # 16 MB


def sets(texts: pa.Array, k: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each text with a shingle, and its distinct shingle hashes in order."""
    for b in blocks(texts):
        data = LOWER[b.data]
        w = words(data, b.offsets, PUNCTUATION)
        h, first = shingles(word_hashes(data, w.starts, w.ends), w.text, k)
        bounds = np.searchsorted(w.text[first], np.arange(b.size + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            yield b.first + int(i), np.unique(h[bounds[i] : bounds[i + 1]])


def level_of(size: int) -> int:
    return max(0, int(size - 1).bit_length())


def entries(found: np.ndarray, level: int) -> np.ndarray:
    """The sketch of a set in a partition: for each bin the smallest hash, as one integer with the partition."""
    bins = np.uint64((4 << level) - 1)
    spread = mix(found)
    spread.sort()  # by hash: the first of each bin is its smallest
    _, at = np.unique(spread & bins, return_index=True)
    return _named(spread[at], level)


def _named(spread: np.ndarray, level: int) -> np.ndarray:
    return mix(spread ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def _each(found: np.ndarray) -> np.ndarray:
    """An entry for every shingle."""
    return _named(mix(found), LEVELS)


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, uid, size, shingles, entries."""
    kind = benchmark.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, found in sets(b.column(2)):
                if len(found) < SMALL:
                    e = _each(found)
                else:
                    low = level_of(max(1, len(found) // 2))
                    e = np.concatenate([entries(found, p) for p in range(low, LEVELS)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([len(found)], pa.int64()), pa.array([found.view(np.int64)]), pa.array([e.view(np.int64)])], ["item", "uid", "size", "shingles", "entries"])

    own = benchmark.select(F.col(id_col).alias("item"), F.monotonically_increasing_id().alias("uid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"item {kind}, uid long, size long, shingles array<long>, entries array<long>")


def _filter(values: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for the last `bits` bits of each value; as bytes. At most 2**bits / 64 rows reach the driver."""
    low = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    got = values.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(v & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _holds(table: np.ndarray, v: np.ndarray) -> np.ndarray:
    low = v & np.uint64(len(table) * 64 - 1)
    return (table[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1


def contained(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs: doc_id, item_id, n_shared, n_item (shingles)."""
    spark = prepare(docs.sparkSession)
    items = cut(_items(benchmark, item_id, item_text))
    table_e = _filter(items.select(F.explode("entries").alias("v")))
    table_s = _filter(items.select(F.explode("shingles").alias("v")))
    shipped = spark.sparkContext.broadcast((table_e, table_s))  # 16 MB each
    smallest = items.agg(F.coalesce(F.min("size"), F.lit(1))).first()[0]
    need = -(-smallest * percent // 100)
    kind = docs.schema[doc_id].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_e, known_s = shipped.value
        for b in batches:
            at, keys, hits = [], [], []
            for i, found in sets(b.column(2)):
                if len(found) < need:
                    continue
                here = found[_holds(known_s, found)]
                if len(here) < need:
                    continue
                e = np.concatenate([entries(found, level_of(len(found))), _each(here)])
                e = e[_holds(known_e, e)]
                if len(e):
                    at.append(i)
                    keys.append(e.view(np.int64))
                    hits.append(here.view(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(keys, pa.list_(pa.int64())), pa.array(hits, pa.list_(pa.int64()))], ["doc", "row", "entries", "hits"])

    own = docs.select(F.col(doc_id).alias("doc"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(doc_text), F.lit("")).alias("text"))
    found = cut(own.mapInArrow(search, f"doc {kind}, row long, entries array<long>, hits array<long>"))
    pairs = (
        found.select("row", F.explode("entries").alias("entry"))
        .join(items.select("uid", F.explode("entries").alias("entry")), "entry")
        .select("row", "uid").distinct()
    )
    verified = (
        pairs.join(items.select("uid", "item", "size", "shingles"), "uid")
        .join(found.select("row", "doc", "hits"), "row")
        .select("doc", "item", F.size(F.array_intersect("hits", "shingles")).cast("long").alias("n_shared"), F.col("size").alias("n_item"))
    )
    return verified.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_shared", "n_item")


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that contain no item. Rows that share an id go together; those without one go by their own text."""
    key = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.concat(F.lit("n"), F.sha2("text", 256)))  # null for no id and no text
    name = unused(docs, "bad")
    bad = contained(docs.select(key.alias("_key"), "text"), benchmark, percent, "_key").select(F.col("_key").alias(name)).distinct()
    return docs.join(bad, key == F.col(name), "left_anti")


_SHINGLES = r"""
SELECT DISTINCT rid, id, array_to_string(w[i:i + 4], ' ') AS s FROM (
  SELECT rid, id, w, unnest(range(1, len(w) - 3)) AS i FROM (
    SELECT row_number() OVER () AS rid, {id} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM {table}))
"""
ORACLE_SQL = f"""
WITH b AS MATERIALIZED ({_SHINGLES.format(id="item_id", table="benchmark")}),
size AS (SELECT rid, count(*) AS n FROM b GROUP BY rid),
d AS MATERIALIZED ({_SHINGLES.format(id="doc_id", table="documents")})
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n) AS n_item
FROM d JOIN b ON d.s = b.s JOIN size ON size.rid = b.rid
GROUP BY d.rid, d.id, b.rid, b.id HAVING count(*) * 100 >= any_value(n) * {PERCENT}
"""
