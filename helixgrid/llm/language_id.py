"""Language identification by bit-sliced Bloom filters of n-grams.

Each slot of the filter holds one bit per language (a mask for each 64 of them). An n-gram of `GRAM` bytes of lower-cased text (every run of
characters other than letters is a space) sets its language's bit in `HASHES` slots; the bitwise and of those slots is
the set of languages that contain it. A text's n-grams are counted per language; a language whose slots are filled to
f answers falsely with probability f**HASHES, and the counts are corrected for that. The largest corrected count
decides; ties go to the first language by name. The score is that count as a share of the text's n-grams.

Training reads a sample of at most about `per_language` documents of each language (by hash of the id, at the rate that
the language's count asks for) and keeps an n-gram for a language if `min_docs` of its sampled documents have it and
its rate there is at least `min_share` of the highest rate in any language. The filter is 2**SLOT_BITS slots of 8 bytes
for each 64 languages, whatever the corpus; that is what is sent to the executors.

Defined cases: a text that is null or has no letter is `und` with score 0; one that has letters but no known n-gram
gets the language of most trainable rows (the first by name of equal ones) with score 0; a long text is looked up in
steps of a fixed size; texts shorter than an n-gram are padded by spaces; no trainable row at all makes every text `und`; repeated rows are predicted
each; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import prepare
from helixgrid.llm.textkernel import LOWER, blocks, mix

GRAM = 4
HASHES = 3
SLOT_BITS = 20
PER_LANGUAGE = 4_000
MIN_DOCS = 3
MIN_SHARE = 0.1
UNKNOWN = "und"
#: Languages are labels: a column of more values is taken for a mistake. A filter of 8 MB serves 64 of them.
MOST_LANGUAGES = 1_024
#: Bytes of training texts that are counted at once.
BLOCK = 1 << 18
_PLAIN = re.compile(rb"[A-Za-z]")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_FOLD = bytes(np.where(_LETTER[LOWER], LOWER, np.uint8(0x20)).astype(np.uint8))
#: n-grams looked up at once: what a worker holds beside its texts.
STEP = 1 << 16


class Model(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # language masks: one row of slots for each 64 languages
    false_rate: np.ndarray  # per language
    usual: str = UNKNOWN  # the language of most trainable rows


def line_of(text: bytes) -> bytes:
    """A text's runs of letters between single spaces, and the spaces that its last n-gram needs; empty without a letter."""
    folded = b" ".join(text.translate(_FOLD).split())
    return b" " + folded + b" " * (GRAM - 1) if folded else b""


def grams_of(line: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The n-grams that begin at lo to hi - 1, as integers."""
    value = np.zeros(hi - lo, np.uint32)
    for j in range(GRAM):
        value = (value << np.uint32(8)) | line[lo + j : hi + j]
    return value.astype(np.uint64)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of a block, and the text of each; a text begins and ends with a space, runs of spaces count as one."""
    values, owner, raw = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], data.tobytes()
    for i in range(len(offsets) - 1):
        line = np.frombuffer(line_of(raw[offsets[i] : offsets[i + 1]]), np.uint8)
        if len(line):
            values.append(grams_of(line, 0, len(line) - GRAM + 1))
            owner.append(np.full(len(line) - GRAM + 1, i))
    return np.concatenate(values), np.concatenate(owner)


def _places(gram: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [(mix(gram + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64) for j in range(HASHES)]


def _mask_columns(n: int) -> int:
    """64 languages to a mask."""
    return -(-n // 64)


def train(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, slot_bits: int = SLOT_BITS) -> Model:
    """The filter of the rows where `trainable` holds and text and language are given."""
    spark = prepare(docs.sparkSession)
    rows = docs.filter(trainable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = sorted((r[0], r[1]) for r in rows.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect())
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: is {lang_col} a language?")
    languages = [x for x, _ in counts]
    if not counts:
        return Model([], np.zeros((1, 1 << slot_bits), np.uint64), np.zeros(0))
    usual = min(counts, key=lambda x: (-x[1], x[0]))[0]
    table = spark.createDataFrame([(x, i, min(1.0, per_language / n), float(min(n, per_language))) for i, (x, n) in enumerate(counts)], "_lang string, lang int, chance double, size double")
    chance = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    known = rows.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("text"), chance.alias("at"))
    sampled = known.join(F.broadcast(table), "_lang").filter("at < chance").select("lang", "text")  # a row for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(0).to_numpy()
            for x in blocks(b.column(1), BLOCK):
                gram, text = grams(x.data, x.offsets)
                if not len(gram):
                    continue
                once = np.unique((text.astype(np.uint64) << np.uint64(32)) | gram)
                both = (lang[x.first + (once >> np.uint64(32)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (once & np.uint64(0xFFFFFFFF))
                pair, n = np.unique(both, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((pair >> np.uint64(32)).astype(np.int32)), pa.array((pair & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    seen = sampled.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    rated = seen.join(F.broadcast(table.select("lang", "size")), "lang").withColumn("rate", F.col("n") / F.col("size"))
    per_gram = rated.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "rate")).alias("have"))  # one entry per language
    mask = F.expr(f"aggregate(filter(have, x -> x.rate >= top * {min_share} and x.lang div 64 = part), 0L, (m, x) -> m | shiftleft(1L, x.lang % 64))")
    parts = per_gram.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_mask_columns(len(counts)) - 1)))).select("gram", "part", mask.alias("mask")).filter("mask <> 0")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), slot_bits))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(1)] * HASHES), pa.array(at.astype(np.int32)), pa.concat_arrays([b.column(2)] * HASHES)], ["part", "slot", "mask"])

    filled = parts.mapInArrow(place, "part int, slot int, mask long").groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    slots = np.zeros((_mask_columns(len(counts)), 1 << slot_bits), np.uint64)
    slots[filled.column("part").to_numpy(), filled.column("slot").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    fill = np.array([np.count_nonzero(slots[i // 64] & np.uint64(1 << i % 64)) / slots.shape[1] for i in range(len(languages))])
    return Model(languages, slots, fill**HASHES, usual)


def _has_letter(text: bytes) -> bool:
    """Of a text with some byte that may be a letter's: any of a to z, or a letter beyond ASCII."""
    return any(c.isalpha() for c in text.decode())


def counts_of(line: bytes, model: Model) -> tuple[int, np.ndarray]:
    """Number of n-grams of a line, and of those whose slots have each language."""
    total = max(0, len(line) - GRAM + 1)
    got = np.zeros(len(model.languages))
    data, bits = np.frombuffer(line, np.uint8), model.slots.shape[1].bit_length() - 1
    for lo in range(0, total, STEP):
        places = _places(grams_of(data, lo, min(total, lo + STEP)), bits)
        for part, slots in enumerate(model.slots):
            mask = slots[places[0]]
            for p in places[1:]:
                mask &= slots[p]
            for i in range(64 * part, min(64 * part + 64, len(got))):
                got[i] += np.count_nonzero(mask & np.uint64(1 << i % 64))
    return total, got


def score_text(text: bytes, model: Model) -> tuple[str, float]:
    """Language and score of one text."""
    line = line_of(text)
    if not line or not model.languages or not (_PLAIN.search(text) or _has_letter(text)):
        return UNKNOWN, 0.0
    total, got = counts_of(line, model)
    false = np.minimum(model.false_rate, 1 - 1e-9)
    fair = np.maximum(0, (got - total * false) / (1 - false))
    best = int(fair.argmax())  # ties: the first by name
    return (model.languages[best], min(1.0, float(fair[best]) / total)) if fair[best] > 0 else (model.usual, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """Columns: id_col, those of `keep` (text_col may be among them), lang_as, score_as."""
    spark = prepare(docs.sparkSession)
    shipped = spark.sparkContext.broadcast(tuple(model))  # 8 MB of slots for each 64 languages, whatever the corpus
    names = list(dict.fromkeys([id_col, *keep]))
    own = docs.select(*names, *([] if text_col in names else [text_col]))
    at = own.columns.index(text_col)  # the text goes to the worker once
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shipped.value)
        for b in batches:
            got, score = zip(*(score_text((t.as_buffer().to_pybytes() if t.is_valid else b""), known) for t in b.column(at)), strict=True) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(got, pa.string()), pa.array(score, pa.float64())], [*names, lang_as, score_as])

    return own.mapInArrow(run, f"{fields}, `{lang_as}` string, `{score_as}` double")


def held_out(id_col: str = "doc_id") -> Column:
    """The fifth of the rows that no model learns from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0
