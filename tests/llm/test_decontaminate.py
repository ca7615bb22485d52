import random
import re

from helixgrid.llm import decontaminate as D


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def brute(docs, items, percent=80):
    def shingles(t):
        w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [(i, shingles(t)) for i, t in items]
    out = []
    for d, t in docs:
        s = shingles(t)
        out += [(d, i, len(q & s), len(q)) for i, q in sets if q and len(q & s) * 100 >= len(q) * percent]
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, n)) for i, n in enumerate([5, 6, 7, 9, 12, 15, 20, 24, 40, 59, 200, 4, 0])] + [(3, prose(rng, 30)), (99, None)]
    docs = []
    for k in range(400):
        body = prose(rng, rng.choice([0, 3, 30, 300, 3000 if k % 40 == 0 else 50])).split()
        if k % 2:
            for _ in range(rng.randint(1, 3)):
                q = (rng.choice(items)[1] or "").split()
                for _ in range(rng.choice([0, 0, 1, 2])):  # break a few shingles
                    if q:
                        q[rng.randrange(len(q))] = "edited"
                at = rng.randint(0, len(body))
                body[at:at] = q
        t = " ".join(body)
        docs.append((k // 2 if k < 20 else k, t.upper() if k % 7 == 0 else t.replace(" ", ", ") if k % 5 == 0 else t))
    docs += [(1000, None), (1001, ""), (1002, items[8][1]), (1002, items[8][1])]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in D.contained(d, b).collect()), key=str)
    want = brute(docs, items)
    assert len(want) > 150 and got == want
    bad = {w[0] for w in want}
    kept = D.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contained(d.limit(0), b).count() == 0 and D.contained(d, b.limit(0)).count() == 0 and D.contained(d, b).count() == 1


def test_rows_without_an_id_are_judged_each(spark):
    item = prose(random.Random(5), 30)
    d = spark.createDataFrame([(None, "a " + item), (None, "clean"), (None, None), (7, item), (8, "a clean row")], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((str(r.doc_id), str(r.text)) for r in D.clean(d, b).collect()) == [("8", "a clean row"), ("None", "None"), ("None", "clean")]
