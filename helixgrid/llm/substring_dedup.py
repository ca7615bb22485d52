"""Substring dedup by hashing of lines and of content-defined parts of texts.

Every line is a unit, whatever its number of words (`line_words` is the least; the queries take 1). A paragraph repeats
where all of its lines do. Passages also repeat in the middle of lines, where hashes of whole lines can't meet; so a unit
begins at each anchor as well: a word whose hash with that of the next word falls into one class of `ANCHOR`. The choice
depends on those two words alone, so a passage has the same anchors in whatever text it lies and however it is wrapped.
The unit of an anchor runs to the first anchor or text end at least `UNIT_WORDS` words on. Units are normalised: words
are runs of letters and digits with A-Z lower-cased, and spaces and punctuation between them don't count.

All units' digests are grouped globally; partial minima are taken before the shuffle. The occurrence of the lowest
(document id, word number) stays. A line that repeats an earlier one goes as a whole. Anchor units that repeat are joined
to runs, and a run grows at both ends for as long as its words are those beside the occurrence that stays: each such
occurrence gives its words back to the anchor before it and on to the end of the next unit, which is where a passage that
holds the unit must end. Runs of anchor units are cut if with lines that go they cover at least `MIN_WORDS` words.
Removed ranges are kept as offsets (code points) into the original text.
The occurrences are joined to the digests that repeat; a hot digest is on one row on that side, so the join can be
split. A task holds one document's units at a time at most. The texts are dealt out by id once and read twice: for the
words beside the occurrences that stay, and to be cut.

Defined cases: null texts stay null and have no units; rows that repeat an id and the text are treated alike (one
document); rows with a null id are never changed; all columns of the input are returned, text changed; with no
repetition, or an empty table, nothing changes; a repetition never takes words of the same text's occurrence that stays
by growing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixgrid.llm.session import prepare, unused
from helixgrid.llm.textkernel import _ORDER, LOWER, PUNCTUATION, Block, blocks, mix, word_hashes, words

ANCHOR = 6
UNIT_WORDS = 8
MIN_WORDS = 12
#: Below this a repeated line stays; whole repetition of lines is 1.
LINE_WORDS = 2


class Units(NamedTuple):
    text: np.ndarray  # index of the text in the block
    at: np.ndarray  # first word (number in the block)
    end: np.ndarray  # end word
    digest: np.ndarray  # odd for lines
    anchors: np.ndarray  # words at which units begin or may end
    hashes: np.ndarray  # of the words, cut to 3 bytes: only neighbours of equal units are compared by them
    words: object


def units(b: Block, anchor: int = ANCHOR, unit_words: int = UNIT_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, object]:
    """Of each anchor's unit: text, first word and end word (numbers in the block), digest; and the block's words."""
    u = all_units(b, anchor, unit_words, 0)
    return u.text, u.at, u.end, u.digest, u.words


def all_units(b: Block, anchor: int = ANCHOR, unit_words: int = UNIT_WORDS, line_words: int = LINE_WORDS) -> Units:
    """Units of anchors and, unless line_words is 0, of lines; in order of the first word."""
    data = LOWER[b.data]
    w = words(data, b.offsets, PUNCTUATION)
    n = len(w.starts)
    none = np.zeros(0, np.int64)
    if not n:
        return Units(none, none, none, none.view(np.uint64), none, np.zeros((0, 3), np.uint8), w)
    h = word_hashes(data, w.starts, w.ends)
    with np.errstate(over="ignore"):
        pair = np.empty(n, np.uint64)
        pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:])
        pair[-1] = 1
        lines = np.cumsum(data == 10)[w.starts]
        new_text = np.empty(n, bool)
        new_text[0] = True
        new_text[1:] = w.text[1:] != w.text[:-1]
        # an anchor looks at the next word; the last of a text has none
        anchors = np.flatnonzero((pair % np.uint64(anchor) == 0) & ~np.append(new_text[1:], True))
        at = anchors
        end = np.minimum(np.append(anchors, n)[np.searchsorted(anchors, at + unit_words)], w.bounds[w.text[at] + 1])
        whole = end - at >= unit_words
        at, end = at[whole], end[whole]
        is_line = np.zeros(len(at), np.uint64)
        if line_words:
            new_line = new_text.copy()
            new_line[1:] |= lines[1:] != lines[:-1]
            line_at = np.flatnonzero(new_line)
            line_end = np.append(line_at[1:], n)
            whole = line_end - line_at >= line_words
            at, end = np.append(at, line_at[whole]), np.append(end, line_end[whole])
            is_line = np.append(is_line, np.ones(np.count_nonzero(whole), np.uint64))
            order = np.argsort(at, kind="stable")
            at, end, is_line = at[order], end[order], is_line[order]
        # a polynomial in the word hashes, moved to begin at the unit
        base = int(_ORDER[7])
        up = _Powers.of(base, n + 1)
        down = _Powers.of(pow(base, -1, 1 << 64), n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * up[:n], out=sums[1:])
        digest = mix((sums[end] - sums[at]) * down[at] + (end - at).astype(np.uint64)) & ~np.uint64(1) | is_line
    return Units(w.text[at], at, end, digest, anchors, h.view(np.uint8).reshape(-1, 8)[:, :3], w)


def beside(u: Units, j: int, unit_words: int) -> tuple[bytes, bytes]:
    """Hashes of the words before a unit, from the anchor before it on, and after it, to the end of the unit that begins there and a word more."""
    at, end, text = int(u.at[j]), int(u.end[j]), int(u.text[j])
    lo, hi = int(u.words.bounds[text]), int(u.words.bounds[text + 1])
    k = int(np.searchsorted(u.anchors, at)) - 1
    m = int(np.searchsorted(u.anchors, end + unit_words))
    first = max(lo, int(u.anchors[k])) if k >= 0 else lo
    last = min(hi, int(u.anchors[m]) + 1) if m < len(u.anchors) else hi
    return u.hashes[first:at].tobytes(), u.hashes[end:last].tobytes()


def alike(own: np.ndarray, other: np.ndarray) -> int:
    """Number of leading words that are the same."""
    n = min(len(own), len(other))
    differ = np.flatnonzero((own[:n] != other[:n]).any(axis=1))
    return int(differ[0]) if len(differ) else n


class _Powers:
    _kept: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, base: int, n: int) -> np.ndarray:
        got = cls._kept.get(base)
        if got is None or len(got) < n:
            steps = np.full(max(n, 1 << 19), base, np.uint64)
            steps[0] = 1
            got = cls._kept[base] = np.cumprod(steps, dtype=np.uint64)
        return got


def _occurrences(docs: DataFrame, id_col: str, text_col: str, anchor: int, unit_words: int, line_words: int) -> DataFrame:
    """digest, id, at (number of the first word in the text)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in blocks(b.column(1)):
                u = all_units(x, anchor, unit_words, line_words)
                if len(u.at):
                    yield pa.RecordBatch.from_arrays([pa.array(u.digest.view(np.int64)), b.column(0).take(pa.array(x.first + u.text)), pa.array((u.at - u.words.bounds[u.text]).astype(np.int32))], ["digest", "id", "at"])

    own = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"digest long, id {kind}, at int")


def _packed(docs: DataFrame, lists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rest, text, and the list of the id or null. The same join wherever it is used, so that texts are dealt out once."""
    of, held = unused(docs, "of_id"), unused(docs, "list")
    joined = docs.join(lists.select(F.col("id").alias(of), F.col("list").alias(held)), F.col(id_col) == F.col(of), "left")
    # other columns ride along as one struct, whatever their names; one join for changed and unchanged rows, as it deals out all texts
    return joined.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("rest"), F.col(text_col).alias("text"), F.col(held).alias("list"))


def _staying(docs: DataFrame, first: DataFrame, id_col: str, text_col: str, anchor: int, unit_words: int, line_words: int) -> DataFrame:
    """digest, id and at of the occurrence that stays, size, and the words before and after it (of anchor units)."""
    kind = docs.schema[id_col].dataType.simpleString()
    place = [c for c in docs.columns if c != text_col].index(id_col)
    wanted = first.groupBy("first.id").agg(F.collect_list(F.struct("first.at", "digest")).alias("list"))  # as many as the document has units at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = pa.array(np.flatnonzero(pc.is_valid(b.column(2)).to_numpy(zero_copy_only=False)))
            if not len(asked):
                continue
            ids, lists = b.column(0).field(place).take(asked), b.column(2).take(asked).to_pylist()
            for x in blocks(b.column(1).take(asked)):
                u = all_units(x, anchor, unit_words, line_words)
                bounds = np.searchsorted(u.text, np.arange(x.size + 1))
                signed, at = u.digest.view(np.int64), (u.at - u.words.bounds[u.text])
                which, rows = [], []
                for i in range(x.size):
                    own = {(r["at"], r["digest"]) for r in lists[x.first + i]}
                    for j in range(bounds[i], bounds[i + 1]):
                        key = (int(at[j]), int(signed[j]))
                        if key in own:
                            which.append(x.first + i)
                            rows.append((key[1], key[0], int(u.end[j] - u.at[j]), *((b"", b"") if key[1] & 1 else beside(u, j, unit_words))))
                if rows:
                    digest, first_at, size, before, after = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(digest, pa.int64()), ids.take(pa.array(which)), pa.array(first_at, pa.int32()), pa.array(size, pa.int32()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], ["digest", "id", "at", "size", "before", "after"])

    found = _packed(docs, wanted, id_col, text_col).mapInArrow(run, f"digest long, id {kind}, at int, size int, before binary, after binary")
    return found.groupBy("digest").agg(F.min(F.struct("id", "at", "size", "before", "after")).alias("first"))  # rows that repeat an id and the text answer each


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, unit_words: int = UNIT_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """id, list: array of the units that repeat an earlier one (at, digest), with the words beside that one and, if it is in the same text, its end."""
    found = _occurrences(docs, id_col, text_col, anchor, unit_words, line_words)
    first = found.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    staying = _staying(docs, first, id_col, text_col, anchor, unit_words, line_words)
    again = found.join(staying, "digest").filter("first.id <> id or first.at <> at")
    own_end = F.when(F.col("first.id") == F.col("id"), F.col("first.at") + F.col("first.size")).otherwise(0)
    return again.groupBy("id").agg(F.collect_list(F.struct("at", "digest", own_end.alias("own_end"), "first.before", "first.after")).alias("list"))  # as many as the document has units at most


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchor: int = ANCHOR, unit_words: int = UNIT_WORDS, min_words: int = MIN_WORDS, line_words: int = LINE_WORDS, removed_as: str = "removed") -> DataFrame:
    """All columns of docs, text_col without repeated lines and passages, and `removed_as`: array of (start, end) in code points of the original. A column of that name gives way."""
    prepare(docs.sparkSession)
    docs = docs.drop(removed_as)
    packed = _packed(docs, removals(docs, id_col, text_col, anchor, unit_words, line_words), id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            again_at = b.column(2).to_pylist()
            hit = [i for i, again in enumerate(again_at) if again]
            if not hit:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([[]] * b.num_rows, span)], ["rest", "text", "removed"])
                continue
            again_at = [again_at[i] for i in hit]
            texts, removed = [], []
            for x in blocks(b.column(1).take(pa.array(hit))):
                u = all_units(x, anchor, unit_words, line_words)
                bounds = np.searchsorted(u.text, np.arange(x.size + 1))
                signed = u.digest.view(np.int64)
                for i in range(x.size):
                    own = {(r["at"], r["digest"]): r for r in again_at[x.first + i]}
                    lo = int(u.words.bounds[i])
                    lines, parts = [], []
                    for j in range(bounds[i], bounds[i + 1]):
                        r = own.get((int(u.at[j]) - lo, int(signed[j])))
                        if r:
                            (lines if r["digest"] & 1 else parts).append((int(u.at[j]), int(u.end[j]), r))
                    gone = going(u, i, lines, parts, min_words)
                    new, spans = cut_out(bytes(x.data[x.offsets[i] : x.offsets[i + 1]]), u.words, int(x.offsets[i]), gone)
                    texts.append(new)
                    removed.append([{"start": a, "end": z} for a, z in spans])
            changed = np.zeros(b.num_rows, bool)
            changed[hit] = True
            all_removed = [[]] * b.num_rows
            for i, r in zip(hit, removed, strict=True):
                all_removed[i] = r
            new = pc.replace_with_mask(b.column(1), pa.array(changed), pa.array(texts, b.column(1).type))
            yield pa.RecordBatch.from_arrays([b.column(0), new, pa.array(all_removed, span)], ["rest", "text", "removed"])

    rest = packed.schema["rest"].dataType.simpleString()
    changed = packed.mapInArrow(run, f"rest {rest}, text string, removed array<struct<start:int,end:int>>")
    return changed.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in docs.columns], F.col("removed").alias(removed_as))


def joined(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Ranges that touch or overlap as one; in order."""
    runs: list[list[int]] = []
    for a, z in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(z, runs[-1][1])
        else:
            runs.append([a, z])
    return runs


def going(u: Units, text: int, lines: list, parts: list, min_words: int) -> list[list[int]]:
    """Ranges of words to cut from a text: lines and parts are (first word, end word, the unit's entry)."""
    lo, hi = int(u.words.bounds[text]), int(u.words.bounds[text + 1])
    whole = [(a, z) for a, z, _ in lines]
    grown, k = [], 0
    while k < len(parts):  # in order of the first word
        a, z, head = parts[k]
        tail = head
        while k < len(parts) and parts[k][0] <= z:
            if parts[k][1] >= z:
                z, tail = parts[k][1], parts[k][2]
            k += 1
        least = max(lo, lo + head["own_end"])
        before, after = (np.frombuffer(x, np.uint8).reshape(-1, 3) for x in (head["before"], tail["after"]))
        if a > least:
            a -= alike(u.hashes[least:a][::-1], before[::-1])
        z += alike(u.hashes[z:hi], after)
        grown.append((a, z))
    runs = joined(grown + whole)
    return joined(whole + [(a, z) for a, z in runs if z - a >= min_words])


def cut_out(text: bytes, w: object, base: int, gone: list[list[int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without ranges of words, and the ranges in code points. `gone` is in order and doesn't overlap."""
    kept, spans, at, chars = [], [], 0, 0
    for a, z in gone:
        start, stop = int(w.starts[a]) - base, int(w.ends[z - 1]) - base
        before = text[at:start].decode()
        cut_text = text[start:stop].decode()
        kept.append(before)
        spans.append((chars + len(before), chars + len(before) + len(cut_text)))
        chars += len(before) + len(cut_text)
        at = stop
    kept.append(text[at:].decode())
    return "".join(kept), spans
