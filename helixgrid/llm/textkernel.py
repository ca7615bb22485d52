"""Words, hashes and shingles of many texts at once, on Arrow's buffers.

A block is a stretch of texts laid end to end in UTF-8. A word's hash is a polynomial in its bytes, read off prefix
sums, and then mixed; all arithmetic is modulo 2**64. A shingle's hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_BASE))
    _ORDER = mix((np.arange(64, dtype=np.uint64) + _U(1)) * _U(0xD1342543DE82EF95)) | _U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Everything but a-z, 0-9 and bytes beyond ASCII, after lower-casing.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = False

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse: at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


class Block(NamedTuple):
    first: int  # index of the first text
    data: np.ndarray  # bytes
    offsets: np.ndarray  # of each text, and the end

    @property
    def size(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Stretches of texts of at most `limit` bytes, or of one longer text. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Block(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    text: np.ndarray  # index of the text in the block
    bounds: np.ndarray  # of the words of each text, and the end


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes that are no separators, within a text."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    return Words(starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xA0761D6478BD642F))


def shingles(hashes: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of a text, and the index of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total += hashes[j : n + j] * _ORDER[j]
        first = np.flatnonzero(text[:n] == text[k - 1 :])
        return mix(total[first]), first
