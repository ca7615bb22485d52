import random
import zlib

from helixgrid.llm import toxicity as T
from helixgrid.llm.language_id import held_out

STEMS = ["grobblo", "snivva", "tarquin"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    syl = ["an", "be", "co", "da", "el", "fi", "go", "hu", "in", "ko", "lu", "me"]
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(5, 200))]
        bad = i % 6 == 0
        if bad:
            for _ in range(1 + len(w) // 60):
                w.insert(rng.randint(0, len(w)), rng.choice(STEMS) + rng.choice(["", "in", "del", "."]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.train(docs, labels, ~held_out())
    truth = {i: y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    out = {r.doc_id: r for r in T.score(docs, model).collect()}
    hit = [out[i].predicted == y for i, y in truth.items()]
    assert len(out) == len(rows) and len(truth) > 80 and sum(hit) / len(hit) >= 0.95
    # the score is that of the text alone
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "an be " * 100_000), (-3, "an be " * 100_000), (-4, "grobblo snivva tarquin an")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in T.score(odd, model).collect()}
    assert got == {-1: 0, -2: 0, -3: 0, -4: 1} and T.score(odd, model).count() == 5


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert T.train(docs, labels, ~held_out()) is None
    assert [tuple(r) for r in T.score(docs, None).orderBy("doc_id").collect()] == [(1, 0.0, 0), (2, 0.0, 0)]
    assert T.score(docs.limit(0), None).count() == 0


def test_windows_cover_all_words():
    text = "ab " * 50 + "x" * 500 + "\n" + "é" * 40
    assert b"".join(b"".join(T.windows(text)).split()) == b"".join(text.encode().split())


def test_scores_equal_plain_python(spark):
    import math

    rows = corpus(240, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), ~held_out())
    toxic, ordinary = T._compressors(model.toxic, model.ordinary)

    def brute(text):
        seen = [max(T.LOW, min(T.HIGH, len(ordinary.compress(w)) - len(toxic.compress(w)))) for w in T.windows(text)]
        counted = sum(max(0.0, model.ratio[x - T.LOW]) for x in seen if x >= 2)
        return 1 / (1 + math.exp(-max(-30, min(30, model.slope * counted / (1 + math.log1p(len(seen))) + model.offset))))

    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert all(abs(got[i].score - brute(t)) < 1e-9 and got[i].predicted == int(got[i].score >= 0.5) for i, t, _ in rows)
