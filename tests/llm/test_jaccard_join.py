import random
import re

import numpy as np
import pyarrow as pa

from helixgrid.llm import jaccard_join as J
from helixgrid.llm.components import components
from helixgrid.llm.session import cut


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(docs, percent=85):
    s = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a][1] and 100 * len(s[a][1] & s[b][1]) >= percent * len(s[a][1] | s[b][1]):
                x, y = sorted((find(s[a][0]), find(s[b][0])))
                root[y] = x
    return sorted((i, len(x), find(i)) for i, x in s)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 6)))
    seeds = [[word() for _ in range(k)] for k in (1, 3, 4, 7, 9, 10, 12, 16, 20, 30, 60, 90, 150, 400, 900)]
    passage = [word() for _ in range(30)]
    docs = []
    for i in range(n):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 40, len(w) // 25])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1])] = [word()] * rng.choice([0, 1, 1])
            w = w or ["x"]
        if i % 9 == 0:
            w = [word() for _ in range(25)] + passage
        docs.append((i * 3 + 1, " ".join(x.upper() if i % 5 == 0 else x for x in w)))
    return docs + [(0, None), (2, ""), (5, " \n"), (8, docs[0][1])]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(seed, 320)
        random.Random(seed).shuffle(docs)
        df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, component_id int")
        got = sorted(tuple(r) for r in J.link(df).collect())
        want = brute(docs)
        assert got == want and len({c for _, _, c in want}) < len(want) - 60
    kept = {r.doc_id for r in J.dedup(df).collect()}
    assert kept == {c for _, _, c in want}


def test_large_group_of_copies_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(i, " ".join([*base[: i % 100], f"e{i}", *base[i % 100 + 1 :]])) for i in range(300)] + [(7, "other text here at all")] * 2 + [(None, "null id")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in J.link(df).collect()]
    assert len(got) == len(docs) and (None, 1, None) in got
    assert {c for i, n, c in got if n > 50} == {0}
    assert J.link(df.limit(0)).count() == 0


def test_shards_hold_every_linked_pair():
    rng = np.random.default_rng(4)
    sizes = J.size_classes(85)
    for n in [6, 7, 8, 11, 13, 20, 40, 100, 300, 700, 3000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            d = n * 15 // 100
            b = np.unique(a[d:]) if rng.random() < 0.5 else np.unique(np.concatenate([a[d // 2 :], rng.integers(0, 1 << 63, max(0, d // 2 - 1)).astype(np.uint64)]))
            if J.enough(len(a), len(b), len(np.intersect1d(a, b)), 85):
                assert np.intersect1d(J.shard_keys(a, sizes), J.shard_keys(b, sizes)).size, n


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(6)
    p = rng.integers(0, 9, (500, J.DIMENSIONS)).astype(np.int32)
    p[100:140] = p[0] + rng.integers(0, 2, (40, J.DIMENSIONS))
    n = p.sum(axis=1).astype(np.int64)
    tree = J.RTree(p, n)
    for i in range(0, 500, 25):
        want = np.flatnonzero(J.enough(n, n[i], np.minimum(p, p[i]).sum(axis=1), 85))
        assert sorted(tree.search(p[i], n[i], 85)) == want.tolist()


def test_runs_and_components(spark):
    key = pa.array([1, 1, 2, 2, 2, 3, 4, 4], pa.int64())
    for size in (1, 2, 3, 8):
        parts = [pa.RecordBatch.from_arrays([key[i : i + size]], ["key"]) for i in range(0, 8, size)]
        got = [t.column(0).to_pylist() for t in J._runs(iter(parts))]
        assert sum(got, []) == key.to_pylist() and all(not set(a) & set(b) for i, a in enumerate(got) for b in got[:i])
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in components(e).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert components(e.limit(0)).count() == 0


def test_rows_that_repeat_an_id_join_all_their_texts(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x"])), (3, " ".join([*b[:-1], "y"])), (4, "z"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert sorted((r.doc_id, r.component_id) for r in J.link(df, groups=0).collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_shards_of_several_blocks(spark):
    """Near copies of three texts: more than a block holds, with outliers that only one other copy links to."""
    rng = random.Random(9)
    base = [[f"{k}w{i}" for i in range(80)] for k in range(3)]
    docs = []
    for i in range(2 * J.BLOCK + 900):
        w = list(base[i % 3 if i % 3 < 2 or i < 300 else 0])
        w[rng.randrange(80)] = f"e{i}"
        docs.append((i, " ".join(w)))
    far = docs[5][1].split()
    far[10], far[40] = "q1", "q2"  # links to document 5 alone, if at all
    docs.append((99_999, " ".join(far)))
    got = {r.doc_id: r.component_id for r in J.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    group = {i: t.split()[0][0] if not t.startswith("e") else t.split()[1][0] for i, t in docs}
    least = {g: min(i for i in group if group[i] == g) for g in "012"}
    links = [i for i, t in docs if i != 99_999 and 100 * len(shingles(t) & shingles(docs[-1][1])) >= 85 * len(shingles(t) | shingles(docs[-1][1]))]
    assert all(got[i] == least[group[i]] for i in got if i != 99_999)
    assert got[99_999] == (got[links[0]] if links else 99_999)


def test_shards_meet_their_roots_once(spark, monkeypatch):
    """Shards are read for the largest components, the guests and the blocks; their join with the roots must not run for each."""
    plans = []

    def spy(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(J, "cut", spy)
    df = spark.createDataFrame(corpus(3, 60), "doc_id long, text string")
    assert sorted(tuple(r) for r in J.link(df).collect()) == brute(corpus(3, 60))
    assert max(p.count("LeftOuter") for p in plans) == 1


def test_rows_are_numbered_across_batches():
    key, node = [1, 1, 1, 2, 3, 3, 3, 4], [5, 5, 6, 7, 8, 9, 10, 11]
    for size in (1, 2, 3, 8):
        parts = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size], pa.int64()), pa.array(node[i : i + size], pa.int64())], ["key", "node"]) for i in range(0, 8, size)]
        got = [tuple(r.values()) for b in J._number(iter(parts)) for r in b.to_pylist()]
        assert got == [(1, 0, 5), (1, 0, 6), (3, 0, 8), (3, 0, 9), (3, 0, 10)]


def test_points_are_packed_without_loss():
    rng = np.random.default_rng(3)
    found = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 5, 255, 256, 900)]
    assert (J.unpack(pa.array([J.pack(f) for f in found], pa.binary())) == np.stack([J.vector(f) for f in found])).all()
