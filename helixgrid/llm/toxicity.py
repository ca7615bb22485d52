"""Toxicity by compression distance.

Two zstandard dictionaries are built. Both begin with the same base, trained by zstandard on windows of ordinary
training texts. The toxic one ends with the word beginnings that toxic training texts have and ordinary ones lack (a
contrastive cover: `MIN_RATIO` times the ordinary document rate, in at least `min_contexts` different surroundings on
either side, so that copies of one text don't count); the ordinary one ends with as many bytes that no text holds. So
the two compress alike but where a window has a toxic segment.

A text is cut into windows of about `WINDOW` bytes at word ends; a window's distance is its compressed length under the
ordinary dictionary minus that under the toxic one. Each distance has a log-likelihood ratio, learnt from whole training
texts; a text's evidence is the sum of the positive ones over a slowly growing function of its number of windows, and a
logistic curve, fitted with the classes' true weights, turns it into a score. The threshold is calibrated: log-odds from
`LOWEST` to 0 count as 0.5, the lowest at which at most `FALSE_SHARE` of the ordinary training texts are marked.

Training reads a sample of at most about `per_class` labelled documents of each class; what reaches the driver is the
segments, `BASE_WINDOWS` windows and one histogram per sampled document. Scoring covers all windows of all texts.

Defined cases: null and empty texts are scored as texts without evidence; without both classes among the labels every
score is 0; labels that repeat a document count once, by the larger; documents without label are not learnt from;
repeated rows are scored each; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import cut, prepare

WINDOW = 64
BASE_BYTES = 16 << 10
BASE_WINDOWS = 20_000
PER_CLASS = 3_000
MIN_RATIO = 8.0
MIN_CONTEXTS = 6
MIN_CONTEXT_SHARE = 0.012  # of the toxic sample
FALSE_SHARE = 0.012
LOWEST = -2.0
LOW, HIGH = -1, 8  # distances beyond count as these

_WINDOW = re.compile(rb"[^\x20\x09-\x0D](?s:.{0,%d})[^\x20\x09-\x0D]*" % (WINDOW - 2))
_WORD = re.compile(r"[^\W\d_]+")


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    ratio: tuple[float, ...]  # log-likelihood ratio of each distance from LOW to HIGH
    slope: float
    offset: float


def windows(text: str | None) -> list[bytes]:
    return [b" " + w for w in _WINDOW.findall((text or "").lower().encode())]


def segments(word: str) -> list[str]:
    """Beginnings of 3 to 8 letters, and the word."""
    return [word[:k] for k in range(3, min(8, len(word)) + 1)] + ([word] if 8 < len(word) <= 16 else [])


@functools.lru_cache(maxsize=4)
def _compressors(*dictionaries: bytes) -> list[zstandard.ZstdCompressor]:
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, min_match=5, window_log=16, hash_log=14, chain_log=14, search_log=8, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for d in dictionaries:
        known = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
    return out


def distances(text: str | None, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Histogram of a text's window distances from LOW to HIGH."""
    t, o = _compressors(toxic, ordinary)
    found = np.array([len(o.compress(w)) - len(t.compress(w)) for w in windows(text)], np.int64)
    return np.bincount(np.clip(found, LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)


def evidence(counts: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Of each row of histograms."""
    positive = np.maximum(ratio, 0)
    positive[: 2 - LOW] = 0  # a byte more or less is noise
    return counts @ positive / (1 + np.log1p(counts.sum(axis=-1)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method, lightly regularised."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - y) * x) + 1e-2 * a, np.sum(weight * (p - y))])
        w = weight * p * (1 - p) + 1e-9
        h = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.0)), float(b)


def _keep_longest(found: dict[str, int]) -> list[str]:
    """Drops a segment where one longer segment explains most of it. Rarest first: zstandard reaches what ends a dictionary at least cost."""
    out = [s for s, n in found.items() if not any(x != s and x.startswith(s) and m >= 0.7 * n for x, m in found.items())]
    return sorted(out, key=lambda s: (found[s], s))


def train(docs: DataFrame, labels: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model | None:
    """The model of the labelled rows where `trainable` holds (a condition on id_col); None without both classes."""
    spark = prepare(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & trainable).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = dict(known.groupBy("y").count().collect())
    if len(counts) < 2:
        return None
    chance = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    rate = F.when(F.col("y") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    chosen = known.filter(chance < rate)  # about twice per_class rows at most, whatever the corpus
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = cut(own.join(F.broadcast(chosen), "id").select("y", "text").repartition(12))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update({s for w in set(_WORD.findall(text.lower())) for s in segments(w)})
            for y in (0, 1):
                if seen[y]:
                    yield pa.RecordBatch.from_arrays([pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y])), pa.array(list(seen[y].values()), pa.int64())], ["y", "segment", "n"])

    got = dict(sample.groupBy("y").count().collect())
    if len(got) < 2:
        return None
    n_toxic, n_ordinary = got[1], got[0]
    per_segment = sample.mapInArrow(count, "y int, segment string, n long").groupBy("segment").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("o"))
    contrast = per_segment.filter((F.col("t") >= MIN_CONTEXTS) & (F.col("t") / n_toxic >= MIN_RATIO * (F.col("o") + 1) / n_ordinary))
    toxic_docs = {r[0]: r[1] for r in contrast.select("segment", "t").collect()}  # at most what the sample has

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = set()
            for text in b.column(1).to_pylist():
                words = ["", *_WORD.findall(text.lower()), ""]
                for i in range(1, len(words) - 1):
                    for s in segments(words[i]):
                        if s in toxic_docs:
                            found |= {(s, 0, words[i - 1]), (s, 1, words[i + 1])}
            if found:
                cols = list(zip(*sorted(found), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2])], ["segment", "side", "word"])

    sides = sample.filter("y = 1").mapInArrow(surroundings, "segment string, side int, word string").distinct().groupBy("segment").pivot("side", [0, 1]).count()
    contexts = {r[0]: min(r[1] or 0, r[2] or 0) for r in sides.collect()}
    least = max(MIN_CONTEXTS, MIN_CONTEXT_SHARE * n_toxic)
    cover = _keep_longest({s: n for s, n in contexts.items() if n >= least and n >= 0.5 * toxic_docs[s]})

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column(1).to_pylist():
                got = windows(text)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], ["w"])

    all_windows = sample.filter("y = 0").mapInArrow(cut_windows, "w binary")
    base_windows = [bytes(r[0]) for r in all_windows.select("w", F.xxhash64("w").alias("h")).distinct().orderBy("h", "w").limit(BASE_WINDOWS).collect()]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, base_windows).as_bytes()[300:]
    except zstandard.ZstdError:  # too little to train on: the windows themselves
        base = b"".join(base_windows)[-BASE_BYTES:]
    tail = b"".join(b" " + s.encode() for s in cover)
    unheard = bytes((37 * i) % 26 + 65 for i in range(len(tail)))  # capitals: windows are lower-cased
    toxic, ordinary = base + tail, base + unheard

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([distances(t, toxic, ordinary) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["y", "counts"])

    rows = sample.mapInArrow(measure, "y int, counts array<long>").collect()  # one histogram per sampled document
    rows.sort()
    y = np.array([r[0] for r in rows])
    h = np.array([r[1] for r in rows])
    share = h / np.maximum(1, h.sum(axis=1, keepdims=True))
    per_class_share = np.stack([(share[y == c].sum(axis=0) * 50 + 0.5) for c in (0, 1)])
    per_class_share /= per_class_share.sum(axis=1, keepdims=True)
    ratio = np.log(per_class_share[1] / per_class_share[0])
    weight = np.where(y == 1, counts[1] / max(1, (y == 1).sum()), counts[0] / max(1, (y == 0).sum())) / (counts[0] + counts[1]) * len(y)
    slope, offset = _fit_curve(evidence(h, ratio), y, weight)
    ordinary_odds = slope * evidence(h[y == 0], ratio) + offset
    threshold = float(np.clip(np.quantile(ordinary_odds, 1 - FALSE_SHARE, method="higher") + 1e-6, LOWEST, 0.0))
    return Model(toxic, ordinary, tuple(ratio.tolist()), slope, offset - threshold)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: id_col, score, predicted."""
    prepare(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.array(model.ratio)
        for b in batches:
            h = np.array([distances(t.as_py(), model.toxic, model.ordinary) for t in b.column(1)]).reshape(b.num_rows, len(ratio))
            p = 1 / (1 + np.exp(-np.clip(model.slope * evidence(h, ratio) + model.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], ["id", "score"])

    scored = own.select("id", F.lit(0.0).alias("score")) if model is None else own.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
