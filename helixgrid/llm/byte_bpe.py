"""Byte-level BPE encoding and decoding of whole texts.

A text of up to `chunk_chars` code points is one chunk and is encoded where it lies. A longer text is cut into
chunks of `chunk_chars` that overlap by `overlap_chars`; the chunks are dealt over the cluster and pre-tokenised in
parallel. Chunk k and its predecessor both pre-tokenise the overlap; the first boundary that both found is where k's
pre-tokens are those of the whole text from there on, since a match of the pattern depends only on what follows its
start. The text between two such points is a piece; pieces are encoded in parallel and their ids concatenated.
A boundary counts only after a non-space character: there a piece's last match cannot depend on what comes next.
If an overlap has no common boundary (one run of letters longer than the overlap), the whole text is encoded at once.

Decoding looks up the bytes of each id and concatenates them.

Defined cases: a null or empty text has no ids; a null id column value is kept; repeated rows give repeated rows;
other columns are dropped, so their names cannot clash; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixgrid.llm.session import prepare

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 2_048
#: Bytes of ids after which a worker hands on what it has.
OUT_BYTES = 4 << 20


@functools.lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


@functools.lru_cache(maxsize=4)
def _vocabulary(ranks: bytes) -> dict[int, bytes]:
    return {int(b): base64.b64decode(a) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}


def encode_text(text: str, ranks: bytes, pattern: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    return np.asarray(_encoding(ranks, pattern).encode_ordinary(text), dtype="<u4").tobytes()


def boundaries(text: str, pattern: regex.Pattern, last: bool) -> list[int]:
    """Ends of pre-tokens after a non-space character; without those that the cut at the text's end may have moved."""
    ends = [m.end() for m in pattern.finditer(text)]
    if not last and ends:
        ends.pop()
    return [e for e in ends if not text[e - 1].isspace()]


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Columns: id_col, token_ids (binary: little-endian unsigned 32-bit integers)."""
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("the overlap must be shorter than a chunk")
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(ranks)  # a vocabulary file: a few MB whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length("text")

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, held, got = 0, 0, []
            for n, text in enumerate(b.column(1)):
                got.append(encode_text(text.as_py(), shipped.value, pattern))
                held += len(got[-1])
                if held >= OUT_BYTES or n == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n + 1 - at), pa.array(got, pa.binary())], ["id", "token_ids"])
                    at, held, got = n + 1, 0, []

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                n = max(1, -(-len(text) // chunk_chars))
                for k in range(n):
                    part = text[k * chunk_chars : (k + 1) * chunk_chars + overlap_chars]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([k], pa.int32()), pa.array([n], pa.int32()), pa.array([part])], ["id", "uid", "k", "n", "part"])

    def pre_tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for b in batches:
            heads, tails = [], []
            for k, n, part in zip(b.column("k").to_pylist(), b.column("n").to_pylist(), b.column("part").to_pylist(), strict=True):
                ends = boundaries(part, compiled, k == n - 1)
                heads.append([e for e in ends if e < overlap_chars] if k else [0])
                tails.append([e - chunk_chars for e in ends if chunk_chars <= e])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], [*b.schema.names, "head", "tail"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for part, start, end, broken, last in zip(*(b.column(c).to_pylist() for c in ("part", "start", "end", "broken", "last")), strict=True):
                if broken:
                    got.append((part if last else part[:chunk_chars]).encode())
                else:
                    got.append(encode_text(part[start:] if last else part[start : chunk_chars + end], shipped.value, pattern))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "uid", "k", "broken")), pa.array(got, pa.binary())], ["id", "uid", "k", "broken", "payload"])

    def whole(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        joined = b"".join(t.column("payload").to_pylist())
        if t.column("broken")[0].as_py():
            joined = encode_text(joined.decode(), shipped.value, pattern)
        return pa.table([t.column("id").slice(0, 1), pa.array([joined], pa.binary())], names=["id", "token_ids"])

    flat = own.filter(size <= chunk_chars).mapInArrow(short, f"id {kind}, token_ids binary")
    chunks = own.filter(size > chunk_chars).select("id", F.monotonically_increasing_id().alias("uid"), "text").mapInArrow(cut_up, f"id {kind}, uid long, k int, n int, part string")
    known = chunks.repartition("uid", "k").mapInArrow(pre_tokenise, f"id {kind}, uid long, k int, n int, part string, head array<int>, tail array<int>")
    by_text = Window.partitionBy("uid").orderBy("k")
    last = F.col("k") == F.col("n") - 1
    stitched = (
        known.withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_text)))))
        .withColumn("end", F.lead("start").over(by_text))
        .withColumn("broken", F.bool_or(F.col("start").isNull()).over(Window.partitionBy("uid")))
        .select("id", "uid", "k", "part", "start", "end", "broken", last.alias("last"))
    )
    done = stitched.mapInArrow(pieces, f"id {kind}, uid long, k int, broken boolean, payload binary").groupBy("uid").applyInArrow(whole, f"id {kind}, token_ids binary")
    return flat.unionByName(done).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks: bytes, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Columns: id_col, token_ids, decoded (binary: the bytes of the ids, concatenated). Null ids decode to no bytes."""
    spark = prepare(encoded.sparkSession)
    shipped = spark.sparkContext.broadcast(ranks)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _vocabulary(shipped.value)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                got = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.binary())], ["id", "token_ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("token_ids"))
    return rows.mapInArrow(run, f"id {kind}, token_ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per text: number of ids, and the SHA-256 of ids and of decoded bytes."""
    return decoded.select(
        id_col,
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def brute_force(text: str | None, ranks: bytes, pattern: str) -> tuple[int, str, str]:
    """The same digests of one text, encoded at once: for tests."""
    ids = encode_text(text or "", ranks, pattern)
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
