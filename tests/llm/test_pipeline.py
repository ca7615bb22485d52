import hashlib
import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from helixgrid.llm import byte_bpe  # noqa: E402
from helixgrid.llm.queries import public_ranks  # noqa: E402

from .test_decontaminate import brute as brute_leaks  # noqa: E402


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def near(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in (words(a), words(b)))
    return len(x & y) * 100 >= 80 * len(x | y)


def tables(tmp_path, spark):
    rng = random.Random(11)
    syl = {"xx": ["lo", "rem", "ip", "sum", "do", "lor"], "yy": ["qui", "ck", "bro", "wn", "fo", "xes"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n))

    docs, items = [], [(i, prose("xx", 25)) for i in range(3)]
    passage = prose("yy", 70)
    for i in range(120):
        lang = "xx" if i % 3 else "yy"
        docs.append((i, prose(lang, rng.randint(30, 120)), lang, "s", 0))
    for i in range(120, 140):  # near copies
        w = docs[i - 120][1].split()
        w[len(w) // 2] = "changed"
        docs.append((i, " ".join(w), docs[i - 120][2], "s", 0))
    for i in range(140, 150):  # leaks
        docs.append((i, prose("xx", 40) + " " + items[i % 3][1] + " " + prose("xx", 40), "xx", "s", 0))
    for i in range(150, 160):  # a shared passage
        docs.append((i, prose("yy", 60) + " " + passage + " " + prose("yy", 60), "yy", "s", 0))
    docs += [(200, None, "xx", "s", 0), (201, "123 !!", None, "s", 0), (202, docs[5][1], "xx", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {d[0]: d[1] for d in docs}, items, passage


def test_stages_against_brute_force(spark, tmp_path):
    docs, items, passage = tables(tmp_path, spark)
    d = str(tmp_path)
    now, texts = spark.read.parquet(f"{d}/documents.parquet"), {}
    columns = now.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/stage{n}")
        now = spark.read.parquet(f"{d}/stage{n}")
        if name != "byte_bpe":
            assert now.columns == columns
            texts[name] = {r.doc_id: r.text for r in now.collect()}
    kept = {i: t for i, t in docs.items() if t and any(c.isalpha() for c in t)}
    assert texts["language_id"] == kept
    want = {}
    for i in sorted(kept):
        if not any(near(kept[i], t) for t in want.values()):
            want[i] = kept[i]
    assert texts["jaccard_join"] == want
    after = texts["substring_dedup"]
    assert set(after) == set(want)
    changed = {i for i in want if after[i] != want[i]}
    assert set(range(151, 160)) <= changed and all(passage not in after[i] for i in range(151, 160))
    seen, left = set(), {}
    for i in sorted(want):  # only what an earlier text has may go, and no long passage stays twice
        w = words(want[i])
        own = {tuple(w[j : j + 8]) for j in range(len(w) - 7)}
        assert i not in changed or own & seen
        seen |= own
        w = words(after[i])
        for j in range(len(w) - 39):
            assert left.setdefault(tuple(w[j : j + 40]), i) == i
    leaks = {i for i, *_ in brute_leaks(list(after.items()), items)}
    assert leaks and texts["decontaminate"] == {i: t for i, t in after.items() if i not in leaks}
    ranks, pattern = public_ranks()
    tokens = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in now.collect()}
    assert tokens == {i: byte_bpe.brute_force(t, ranks, pattern) for i, t in texts["decontaminate"].items()}
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, d).collect()) == sorted(t[1] for t in tokens.values())
    assert all(t[2] == hashlib.sha256(texts["decontaminate"][i].encode()).hexdigest() for i, t in tokens.items())


def test_clashing_columns_null_ids_and_no_rows(spark, tmp_path):
    text = " ".join(f"lorem{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"{text} w{i}", "xx", 0, "a", "b", "c", "d", "e") for i in range(1, 12)] + [(None, text, "xx", 0, "a", "b", "c", "d", "e"), (3, None, None, None, None, None, None, None, None)]
    schema = "doc_id long, text string, lang string, score int, lang_pred string, removed string, gone string, list string, component_id string"
    spark.createDataFrame([(1, "no such words " * 4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, data in (("some", rows), ("none", [])):
        now = spark.createDataFrame(data, schema)
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{n}")
            now = spark.read.parquet(f"{tmp_path}/{name}{n}")
            assert [(f.name, f.dataType.simpleString()) for f in now.schema] == [tuple(c.split()) if c.split()[1] != "long" else (c.split()[0], "bigint") for c in schema.split(", ")]
        kept = {r.doc_id: (r.score, r.removed, r.gone, r.list) for r in now.collect()}
        assert kept == ({1: (0, "b", "c", "d"), None: (0, "b", "c", "d")} if data else {})
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == len(kept)
