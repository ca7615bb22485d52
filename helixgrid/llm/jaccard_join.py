"""n-gram Jaccard join over a count-vector R-tree.

A document's set is that of its distinct `SHINGLE`-word shingles (of its whole word sequence, if it has fewer words);
words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Two documents link if 100 * intersection >= percent * union.

1. Documents with equal sets are one class: the node of the graph. Set digests are pre-aggregated.
2. Shards say which nodes share an R-tree. Linked sets differ in few shingles: at most (100 - percent) / (100 + percent)
   of the sum of their sizes. Sets are put into size classes (their own and the next, so that linked sets share one); in
   a class whose largest pair may differ in H shingles, shingles are hashed into more than H groups, so at least one
   group holds the same shingles on both sides. A shard is what agrees in (size class, group, the group's shingles). A
   group without shingles says nothing: a set with such a group is dealt out once more by other groups, up to `SEEDS`
   times. Up to `groups` groups all serve; where there are more, that many of them do, of which at least 44 % are
   expected to agree, which misses a linked pair with a probability below 1e-12 for the default (0: all groups serve).
3. Count vectors. Shingles are hashed into `DIMENSIONS` groups; the counts are a point. The overlap of two sets is at
   most the sum of the coordinates' minima; that of a set with all points under a node of an R-tree is at most the sum
   of minima with the node's upper corner. A shard is cut into blocks of `BLOCK` nodes, each a bulk-loaded R-tree.
4. First search: the node nearest to a block's mean leads; what the tree finds for it may link with it and leaves the
   block, and so on. A node thus names one pair in a block, however many copies it has there, and keeps the one most
   of its blocks name. The leads of a shard's blocks are searched among themselves. The pairs are verified by the exact
   intersection, and components are merged.
5. Second search: in shards that still hold several components, the tree finds for each node outside the largest one
   all that may link and lie in another component; in a shard of several blocks such nodes visit each block. All
   surviving pairs are verified. So no link between components is lost.

Shard rows are 20 bytes; sets travel only for nodes that share a shard, and to the task that verifies a pair: rows
are dealt by the first node and one of `SALTS` salts, and streamed past its set.

Defined cases: null and empty texts have an empty set, link with nothing and are their own component; ids are
documents: rows that repeat an id are joined, whatever their texts, each row keeping its own set size; a null id has a
null component and links nothing; other columns are dropped; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from helixgrid.llm.components import components
from helixgrid.llm.decontaminate import _filter, _holds
from helixgrid.llm.session import cut, prepare, unused
from helixgrid.llm.textkernel import LOWER, SPACE, blocks, mix, shingles, word_hashes, words

SHINGLE = 4
PERCENT = 85
GROUPS = 48
DIMENSIONS = 256
SEEDS = 8
FANOUT = 16
BLOCK = 4_096
#: Shards of up to so many nodes are one leaf: their bounds are taken many shards at a time.
LEAF = 16
SALTS = 256
_GOLD = 0x9E3779B97F4A7C15


def sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index of each text that has words, and its set as sorted hashes."""
    for b in blocks(texts):
        data = LOWER[b.data]
        w = words(data, b.offsets, SPACE)
        h = word_hashes(data, w.starts, w.ends)
        s, first = shingles(h, w.text, k)
        bounds = np.searchsorted(w.text[first], np.arange(b.size + 1))
        counts = np.diff(w.bounds)
        for i in np.flatnonzero(counts):
            if counts[i] >= k:
                yield b.first + int(i), np.unique(s[bounds[i] : bounds[i + 1]])
            else:
                own = h[w.bounds[i] : w.bounds[i + 1]]
                with np.errstate(over="ignore"):
                    total = np.uint64(counts[i])
                    for x in own:
                        total = mix(np.array([total * np.uint64(_GOLD) + x]))[0]
                yield b.first + int(i), np.array([total], np.uint64)


class Sizes:
    """Size classes: (upper bound, groups) of each, of which `serve` serve (0: all)."""

    def __init__(self, percent: int, serve: int = GROUPS, most: int = 1 << 40) -> None:
        self.percent, self.serve = percent, serve or most
        # below this size, sets that differ can't link
        self.least = next(n for n in range(1, 1 << 20) if (n - 1) * 100 >= percent * n) - 1 if percent < 100 else most
        self.upper, self.groups = [], []
        u = self.least
        while not self.upper or self.upper[-1] < most:
            self.upper.append(u)
            differ = 2 * u * (100 - percent) // (100 + percent)
            self.groups.append(differ + 1 if differ < self.serve else max(differ + 1, differ * 5 // 4))
            u = max(u + 1, -(-u * 100 // percent))
        self.upper_array = np.array(self.upper)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.upper_array, n))


@functools.lru_cache(maxsize=8)
def size_classes(percent: int, serve: int = GROUPS) -> Sizes:
    return Sizes(percent, serve)


def shard_keys(found: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The shards of a set: for its own size class and the next."""
    n = len(found)
    if n < sizes.least:
        return np.zeros(0, np.uint64)
    out = []
    for i in (sizes.of(n), sizes.of(n) + 1):
        k = sizes.groups[i]
        used = min(k, sizes.serve)
        for seed in range(SEEDS):
            with np.errstate(over="ignore"):
                spread = mix(found ^ np.uint64((i * SEEDS + seed + 1) * _GOLD % (1 << 64)))
                group = (spread >> np.uint64(20)) % np.uint64(k)
                mine = group < used
                g = group[mine].astype(np.int64)
                content = np.zeros(used, np.uint64)
                np.add.at(content, g, mix(spread[mine] + np.uint64(1)))
                full = np.bincount(g, minlength=used) > 0
                again = k <= sizes.serve and not full.all()
                # an empty group counts only where every seed leaves one; of many groups enough others agree
                here = np.arange(used) if again and seed == SEEDS - 1 else np.flatnonzero(full)
                out.append(mix(content[here] ^ mix((here.astype(np.uint64) + np.uint64((i * SEEDS + seed) << 20)) * np.uint64(_GOLD))))
            if not again:
                break
    return np.concatenate(out)


def vector(found: np.ndarray) -> np.ndarray:
    """Counts as bytes. A set too large for them gets all 255: nothing bounds it, and its pairs are verified."""
    counts = np.bincount((found >> np.uint64(7)).astype(np.int64) % DIMENSIONS, minlength=DIMENSIONS)
    return (counts if counts.max() < 255 else np.full(DIMENSIONS, 255)).astype(np.uint8)


def enough(a: np.ndarray, b: np.ndarray, overlap: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b with such an overlap link."""
    return 100 * overlap >= percent * (a + b - overlap)


class RTree:
    """Bulk-loaded over count vectors: nodes of FANOUT children with their upper corner and smallest size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        self.order, self.levels = order, [(points[order], sizes[order])]
        while len(self.levels[-1][0]) > FANOUT:
            corner, least = self.levels[-1]
            cuts = np.arange(0, len(corner), FANOUT)
            self.levels.append((np.maximum.reduceat(corner, cuts), np.minimum.reduceat(least, cuts)))

    def search(self, q: np.ndarray, n: int, percent: int) -> np.ndarray:
        """Numbers of the points whose overlap with q may suffice."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            corner, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(corner)]
            bound = np.minimum(corner[at], q).sum(axis=1, dtype=np.int64)
            if q[0] == 255:  # a set beyond byte counts, or a node that holds one
                bound[:] = n
            bound[corner[at, 0] == 255] = n
            at = at[enough(least[at], n, np.minimum(bound, n), percent)]
        return self.order[at]


def unpack(stored: pa.Array) -> np.ndarray:
    """Points of rows: counts, or for a set of fewer than DIMENSIONS shingles the group of each."""
    offsets = np.frombuffer(stored.buffers()[1], np.int32)[stored.offset : stored.offset + len(stored) + 1].astype(np.int64)
    data = np.frombuffer(stored.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    out = np.zeros((len(stored), DIMENSIONS), np.uint8)
    counts = size == DIMENSIONS
    by_byte = np.repeat(counts, size)
    out[counts] = data[by_byte].reshape(-1, DIMENSIONS)
    row = np.repeat(np.arange(len(stored)), size)[~by_byte]
    return out + np.bincount(row * DIMENSIONS + data[~by_byte], minlength=out.size).astype(np.uint8).reshape(out.shape)


def pack(found: np.ndarray) -> bytes:
    """What unpack reads."""
    return ((found >> np.uint64(7)) % np.uint64(DIMENSIONS)).astype(np.uint8).tobytes() if len(found) < DIMENSIONS else vector(found).tobytes()


def bounds(points: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the overlap of rows i and j may suffice."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        least = np.minimum(sizes[a], sizes[b])
        most = np.minimum(points[a], points[b]).sum(axis=1, dtype=np.int64)
        most = np.where((points[a, 0] == 255) | (points[b, 0] == 255), least, np.minimum(most, least))
        out[at : at + (1 << 14)] = enough(sizes[a], sizes[b], most, percent)
    return out


def _leaf_pairs(run: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j), i first, of the runs of at most LEAF rows. run: number of the run of each row, ascending; size: of each run."""
    small = size[run] <= LEAF
    left, right = [], []
    for d in range(1, LEAF):
        i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:])) if len(run) > d else np.zeros(0, np.int64)
        left.append(i)
        right.append(i + d)
    return np.concatenate(left), np.concatenate(right)


def lead_pairs(points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], int]:
    """(leading row, row that may link with it), each row named once at most; and the first to lead."""
    tree, left, out, first, alone = RTree(points, sizes), np.ones(len(points), bool), [], -1, False
    while left.any():
        rows = np.flatnonzero(left)
        if alone:  # the last lead found nothing: a middle says little here
            lead = int(rows[0])
        else:
            lead = int(rows[np.abs(points[rows] - points[rows].mean(axis=0, dtype=np.float32)).sum(axis=1).argmin()])
        first = lead if first < 0 else first
        got = tree.search(points[lead], sizes[lead], percent)
        got = got[left[got]]
        out += [(lead, int(x)) for x in got if x != lead]
        alone = len(got) < 2
        left[got] = False
        left[lead] = False
    return out, first


def _first_search(percent: int):
    """Rows (cell, key, block, several, node, n, point) in order of cell: pairs (a, b) with key null; and, of shards of several blocks, (a, null, key) for the lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            cell, node, n, several, shard = (t.column(c).to_numpy() for c in ("cell", "node", "n", "several", "key"))
            points = unpack(t.column("point").combine_chunks())
            cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            size = np.diff(cuts)
            i, j = _leaf_pairs(np.repeat(np.arange(len(size)), size), size)
            good = bounds(points, n, i, j, percent)
            i, j = i[good], j[good]
            # in a small block each row names the first that it may link with
            order = np.lexsort((i, j))
            i, j = i[order], j[order]
            head = np.append(True, j[1:] != j[:-1]) if len(j) else np.zeros(0, bool)
            a, b = [node[i[head]]], [node[j[head]]]
            leads = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > LEAF:
                    pairs, first = lead_pairs(points[lo:hi], n[lo:hi], percent)
                    if pairs:
                        x = np.array(pairs) + lo
                        a.append(node[x[:, 0]])
                        b.append(node[x[:, 1]])
                    if several[lo]:
                        leads.append((int(node[lo + first]), int(shard[lo])))
                elif several[lo]:
                    leads.append((int(node[lo]), int(shard[lo])))
            yield _named(np.concatenate(a), np.concatenate(b), leads)

    return run


def _named(a: np.ndarray, b: np.ndarray, leads: list[tuple[int, int]]) -> pa.RecordBatch:
    none = len(leads)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.append(a, np.array([x for x, _ in leads], np.int64))), pa.array([*b.tolist(), *[None] * none], pa.int64()), pa.array([*[None] * len(a), *[k for _, k in leads]], pa.int64())],
        ["a", "b", "key"],
    )


def _lead_search(percent: int):
    """Rows (key, node, n, point) of leads in order of key: pairs (a, b). A shard's leads are taken BLOCK at a time, the first with each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_of, head = None, None
        for t in _runs(batches):
            key, node, n = (t.column(c).to_numpy() for c in ("key", "node", "n"))
            points = unpack(t.column("point").combine_chunks())
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                for at in range(lo, hi, BLOCK):
                    to = min(hi, at + BLOCK)
                    nodes, p, m = node[at:to], points[at:to], n[at:to]
                    if key_of == key[lo]:
                        nodes, p, m = np.append(head[0], nodes), np.concatenate([head[1], p]), np.append(head[2], m)
                    pairs, first = lead_pairs(p, m, percent)
                    key_of, head = key[lo], (nodes[first : first + 1], p[first : first + 1], m[first : first + 1])
                    if pairs:
                        x = np.array(pairs)
                        yield pa.RecordBatch.from_arrays([pa.array(nodes[x[:, 0]]), pa.array(nodes[x[:, 1]])], ["a", "b"])

    return run


def _second_search(percent: int):
    """Rows (cell, node, n, point, root, guest) in order of cell: all survivors (a, b) of different components. A guest, of a shard of several blocks, looks for partners and is none, but in its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            cell, node, n, root, guest = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "node", "n", "root", "guest"))
            cuts = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
            size = np.diff(cuts)
            run_of = np.repeat(np.arange(len(size)), size)
            opened = np.minimum.reduceat(root, cuts[:-1]) != np.maximum.reduceat(root, cuts[:-1])
            if not opened.any():
                continue
            points = unpack(t.column("point").combine_chunks())
            i, j = _leaf_pairs(run_of, size)
            apart = (root[i] != root[j]) & ~(guest[i] & guest[j])
            i, j = i[apart], j[apart]
            good = bounds(points, n, i, j, percent)
            found = [np.stack([node[i[good]], node[j[good]]])]
            for lo, hi in zip(cuts[:-1][opened & (size > LEAF)], cuts[1:][opened & (size > LEAF)], strict=True):
                for part in _open_pairs(root[lo:hi], guest[lo:hi], points[lo:hi], n[lo:hi], percent):
                    found.append(node[lo + part])
                    if sum(x.shape[1] for x in found) > 1 << 16:
                        yield _pairs(found)
                        found = []
            if found:
                yield _pairs(found)

    return run


def _open_pairs(root: np.ndarray, guest: np.ndarray, points: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Survivors of a block between different components, as two rows of row numbers; a few at a time."""
    home = np.flatnonzero(~guest)
    kinds, inverse, count = np.unique(root[home], return_inverse=True, return_counts=True)
    if not len(home):
        return
    # each pair has a side outside the block's largest component
    asking = np.append(home[inverse != count.argmax()], np.flatnonzero(guest))
    tree = RTree(points[home], sizes[home])
    for i in asking:
        got = home[tree.search(points[i], sizes[i], percent)]
        got = got[root[got] != root[i]]
        if len(got):
            yield np.stack([np.full(len(got), i), got])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of equal first column, in order; several to a table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1], "left"))
        if held and (last or held[-1].column(0)[-1] != b.column(0)[0]):
            # the run that was held ends in this batch or before it
            if held[-1].column(0)[-1] == b.column(0)[0]:
                yield pa.Table.from_batches([*held, b.slice(0, last)])
            else:
                yield pa.Table.from_batches(held)
                if last:
                    yield pa.Table.from_batches([b.slice(0, last)])
            held = []
        elif last:
            yield pa.Table.from_batches([b.slice(0, last)])
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order: (key, block, node) of keys with several nodes, each once. One row is held back, whatever the run's length."""
    key, node, rank = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the last row seen, and its number in its run
    for b in batches:
        if not b.num_rows:
            continue
        k, v = np.append(key, b.column(0).to_numpy()), np.append(node, b.column(1).to_numpy())
        fresh = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))
        k, v = k[fresh], v[fresh]
        start = np.append(True, k[1:] != k[:-1])
        begin = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
        at = np.arange(len(k)) - begin + np.where(begin == 0, rank, 0)
        same = k[1:] == k[:-1]
        keep = (at > 0) | np.append(same, False)
        keep[-1] = False  # what follows it decides
        yield from _numbered(k[keep], at[keep], v[keep])
        key, node, rank = k[-1:], v[-1:], int(at[-1])
    if len(key) and rank > 0:
        yield from _numbered(key, np.array([rank]), node)


def _numbered(key: np.ndarray, at: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(key):
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array((at // BLOCK).astype(np.int32)), pa.array(node)], ["key", "block", "node"])


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    x = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x[0].astype(np.int64)), pa.array(x[1].astype(np.int64))], ["a", "b"])


def _verify(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Rows are dealt by a and a salt of b; a's set goes once to each."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt"))
    known = features.select("node", "found")
    left = salted.select("a", "salt").distinct().join(known, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "found")
    right = salted.join(known, F.col("b") == F.col("node")).select("a", "salt", "b", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, who = None, None
        for batch in batches:
            got_a, got_b = [], []
            flat, at = batch.column("found"), batch.column("found").offsets.to_numpy()
            values = flat.values.to_numpy().view(np.uint64)
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                mine = values[at[i] : at[i + 1]]
                if b is None:
                    base, who = mine.copy(), a
                elif who == a:
                    at_base = np.searchsorted(base, mine)
                    common = int((base[np.minimum(at_base, len(base) - 1)] == mine).sum())
                    if enough(len(base), len(mine), common, percent):
                        got_a.append(a)
                        got_b.append(b)
            if got_a:
                yield pa.RecordBatch.from_arrays([pa.array(got_a, pa.int64()), pa.array(got_b, pa.int64())], ["a", "b"])

    streamed = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return streamed.select("a", "b", "found").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """Columns: id_col, n_shingles, component_id. id_col is an integer column. groups = 0: no chance to miss a link, at more rows for long texts."""
    return _link(docs, percent, shingle, id_col, text_col, groups)[0]


def _link(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str, groups: int) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What link() returns, and the pairs of each step."""
    spark = prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col} must be an integer column")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"))
    sizes = size_classes(percent, groups)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x, y = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            for i, found in sets(b.column(2), shingle):
                n[i], x[i], y[i] = len(found), mix(found ^ np.uint64(_GOLD)).sum(), mix(found + np.uint64(_GOLD)).sum()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["id", "t", "n", "x", "y"])

    per_row = cut(own.mapInArrow(digest, "id long, t long, n long, x long, y long"))
    usable = per_row.filter("n > 0 and id is not null")
    # numbered once, when the checkpoint is written
    classes = cut(usable.groupBy("n", "x", "y").agg(F.min("id").alias("id"), F.min_by("t", "id").alias("t")).select("*", F.monotonically_increasing_id().alias("node")))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            nodes = b.column(0).to_numpy()
            keys, own_nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, found in sets(b.column(1), shingle):
                if nodes[i] == last:  # a row that repeats id and text
                    continue
                last = nodes[i]
                keys.append(shard_keys(found, sizes))
                own_nodes.append(np.full(len(keys[-1]), last))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(own_nodes))], ["key", "node"])

    texts = own.join(classes.filter(F.col("n") >= sizes.least).select("id", "t", "node"), ["id", "t"])
    spread = texts.select("node", "text").mapInArrow(shards, "key long, node long")
    shared = cut(spread.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_number, "key long, block int, node long"))
    active = classes.join(shared.select("node").distinct(), "node", "left_semi").select("id", "t", "node")
    known = spark.sparkContext.broadcast(_filter(active.select(F.xxhash64("id", "t").alias("v"))))  # 16 MB whatever the corpus

    def maybe_active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = _holds(known.value, b.column(3).to_numpy().view(np.uint64))
            if keep.any():
                yield b.filter(pa.array(keep)).select([0, 1, 2])

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            for lo in range(0, b.num_rows, 32):
                part = b.slice(lo, 32)
                nodes, out = part.column(0).to_numpy(), []
                for i, found in sets(part.column(1), shingle):
                    if nodes[i] != last:
                        last = nodes[i]
                        out.append((int(last), len(found), pack(found), found.view(np.int64)))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int64()))], ["node", "n", "point", "found"])

    likely = own.filter("id is not null").select("id", "t", "text", F.xxhash64("id", "t").alias("v")).mapInArrow(maybe_active, "id long, t long, text string")
    features = cut(likely.join(active, ["id", "t"]).select("node", "text").mapInArrow(features_of, "node long, n long, point binary, found array<long>"))
    points = features.select("node", "n", "point")
    blocks_of = shared.filter("block > 0").groupBy("key").agg(F.max("block").alias("last"))  # a row for each shard of over BLOCK nodes

    placed = shared.join(blocks_of, "key", "left").select("key", F.xxhash64("key", "block").alias("cell"), "node", F.col("last").isNotNull().cast("int").alias("several"))
    in_blocks = placed.join(points, "node").repartition("cell").sortWithinPartitions("cell", "node").select("cell", "key", "node", "n", "several", "point")
    named = cut(in_blocks.mapInArrow(_first_search(percent), "a long, b long, key long"))
    leads = named.filter("key is not null").select("key", F.col("a").alias("node")).join(points, "node").repartition("key").sortWithinPartitions("key", "node").select("key", "node", "n", "point")
    most_named = named.filter("key is null").groupBy("b").agg(F.mode("a", True).alias("a")).select("a", "b")
    first = cut(most_named.unionByName(leads.mapInArrow(_lead_search(percent), "a long, b long")).distinct())
    links = cut(_verify(first, features, percent))
    # rows of one id are one document, whatever their sets
    several_sets = usable.groupBy("id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in "nxy" for f in (F.min, F.max)]).filter("min_n <> max_n or min_x <> max_x or min_y <> max_y").select("id")
    by_id = usable.join(several_sets, "id").join(classes.select("n", "x", "y", "node"), ["n", "x", "y"]).select("id", "node").distinct()
    same_id = by_id.join(by_id.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b")).filter("a <> b")
    roots = cut(components(links.unionByName(same_id)))

    # read three times below, joined once
    numbered = cut(shared.join(roots, "node", "left").select("key", "block", "node", F.coalesce("root", "node").alias("root")))
    # of shards of several blocks, all but the largest component's nodes visit the other blocks
    per_root = numbered.join(blocks_of, "key").groupBy("key", "last", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = per_root.groupBy("key", "last").agg(F.max(F.struct("m", "root"))["root"].alias("top"), F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    guests = numbered.join(largest, "key").filter("root <> top").withColumn("to", F.explode(F.sequence(F.lit(0), "last"))).filter("to <> block")
    rows = numbered.withColumn("guest", F.lit(False)).unionByName(guests.select("key", F.col("to").alias("block"), "node", "root", F.lit(True).alias("guest")))
    in_cells = rows.join(points, "node").select(F.xxhash64("key", "block").alias("cell"), "node", "n", "point", "root", "guest").repartition("cell").sortWithinPartitions("cell", "guest", "node")
    survivors = cut(in_cells.mapInArrow(_second_search(percent), "a long, b long").distinct().join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    more = cut(_verify(survivors, features, percent))
    merged = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    tops = components(merged.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    final = roots.select("node", "root").unionByName(tops.join(roots.select("node"), "node", "left_anti")).join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    placed_classes = classes.join(final, "node", "left").select("n", "x", "y", "id", F.coalesce("root", "node").alias("root"))
    least = placed_classes.groupBy("root").agg(F.min("id").alias("component"))
    by_class = placed_classes.select("n", "x", "y", "root").join(least, "root").select("n", "x", "y", "component")
    got = per_row.join(by_class, ["n", "x", "y"], "left")
    out = got.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).cast(kind).alias("component_id"))
    return out, {"first pairs": first, "first links": links, "pairs of the tree": survivors, "links of the tree": more}


def dedup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component, or have a null id."""
    name = unused(docs, "gone")
    gone = link(docs.select(id_col, text_col), percent, shingle, id_col, text_col).filter(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


ORACLE_SQL = rf"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS i FROM w WHERE len(words) >= {SHINGLE})
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND {SHINGLE - 1}),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {PERCENT} * (p.n + q.n - c)),
reach(node, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT b, root FROM reach JOIN links ON a = node)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node) USING (doc_id)
"""
