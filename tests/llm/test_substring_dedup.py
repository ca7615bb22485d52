import random
import re

from helixgrid.llm import substring_dedup as S


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


def words(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())


def test_repeats_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (51, 60, 80, 120, 400)]
    docs = {}
    for i in range(200):
        body = prose(rng, rng.randint(20, 300))
        docs[i] = (body, None)
        if i % 2:
            cut, p = rng.randint(0, len(body)), rng.randrange(len(passages))
            docs[i] = (body[:cut] + " " + passages[p] + " " + body[cut:], p)
    df = spark.createDataFrame([(i, t, "é", 5) for i, (t, _) in docs.items()], "doc_id long, text string, source string, removed int")
    out = {r.doc_id: r for r in S.dedup(df).collect()}
    assert set(out) == set(docs)
    seen = set()
    for i in sorted(docs):
        text, p = docs[i]
        r = out[i]
        # offsets are of the original text
        rest, at = [], 0
        for s in r.removed:
            rest.append(text[at : s.start])
            at = s.end
        assert "".join(rest) + text[at:] == r.text
        if p is None or p not in seen:
            assert r.text == text
        else:
            w, q = words(r.text), words(passages[p])
            left = {tuple(w[j : j + 40]) for j in range(len(w) - 39)} & {tuple(q[j : j + 40]) for j in range(len(q) - 39)}
            assert not left, (i, p)
        seen.add(p)


def test_units_do_not_depend_on_what_stands_around():
    import pyarrow as pa

    rng = random.Random(5)
    p = prose(rng, 200).replace("\n", " ")
    texts = [p, "zz yy " + p, prose(rng, 33) + " " + p.upper().replace(" ", "  "), "", p * 2]
    (b,) = S.blocks(pa.array(texts))
    text, at, end, digest, w = S.units(b)
    per = [set(digest[text == i].tolist()) for i in range(len(texts))]
    assert len(per[0]) > 10 and len(per[0] - per[1]) <= 2 and len(per[0] - per[2]) <= 2 and not per[3] and len(per[0] - per[4]) <= 2


def test_defined_cases(spark):
    rng = random.Random(9)
    long = prose(rng, 100)
    df = spark.createDataFrame([(1, None), (2, ""), (None, long), (4, long), (3, long), (3, long), (5, long + "\n" + long)], "doc_id long, text string")
    got = S.dedup(df)
    assert got.columns == ["doc_id", "text", "removed"]
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert (1, None) in rows and (2, "") in rows and rows.count((3, long)) == 2 and (None, long) in rows
    assert len(next(t for i, t in rows if i == 4)) < 120 and len(next(t for i, t in rows if i == 5)) < 240
    assert S.dedup(df.limit(0)).count() == 0


def test_short_lines_go_as_a_whole(spark):
    rng = random.Random(13)
    license = "Licensed under the Apache License, Version 2.0"
    tops = [prose(rng, 30).replace("\n", " ") for _ in range(6)]
    texts = [f"{tops[0]}\n{license}\n{tops[1]}", f"{tops[2]}\n  {license.upper()}\n{tops[3]}", f"{tops[4]}\nEnd\n", f"End.\n{tops[5]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in S.dedup(df, line_words=1).orderBy("doc_id").collect()]
    assert got == [texts[0], f"{tops[2]}\n  \n{tops[3]}", texts[2], f".\n{tops[5]}"]


def test_passages_go_to_their_ends(spark):
    rng = random.Random(17)
    plain = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(6)) for _ in range(n))
    docs, want = [], []
    for i in range(60):
        p, *around = plain(rng.randint(60, 200)), plain(25), plain(20), plain(30), plain(35)
        docs += [(2 * i, f"{around[0]} {p} {around[1]}"), (2 * i + 1, f"{around[2]} {p.replace(' ', chr(10), i % 3)} {around[3]}")]
        want += [docs[-2][1], f"{around[2]}  {around[3]}"]
    # the occurrence that stays in the same text stays whole
    own = plain(60)
    docs.append((1000, f"{own} {own}"))
    want.append(f"{own} ")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert [r.text for r in S.dedup(df).orderBy("doc_id").collect()] == want


def test_lines_equal_brute_force(spark):
    """Texts of lines whose words no other line has: a line goes where an earlier (doc_id, place) has it."""
    import random
    import re

    from helixgrid.llm import substring_dedup as S

    rng = random.Random(8)
    pool = [" ".join(f"w{i}x{j}" for j in range(rng.choice([1, 2, 5, 9, 20]))) for i in range(150)]
    docs = [(i, "\n".join(rng.choice(pool) + rng.choice(["", ".", " !"]) for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    seen, want = set(), {}
    for i, text in docs:
        gone, at = [], 0
        for line in text.split("\n"):
            words = [(m.start() + at, m.end() + at) for m in re.finditer(r"[A-Za-z0-9]+", line)]
            key = tuple(text[a:z] for a, z in words)
            gone += [(*w, bool(key) and key in seen) for w in words]
            seen.add(key)
            at += len(line) + 1
        spans = []
        for k, (a, z, cut) in enumerate(gone):
            if cut and spans and k and gone[k - 1][2]:
                spans[-1][1] = z
            elif cut:
                spans.append([a, z])
        kept, at = "", 0
        for a, z in spans:
            kept, at = kept + text[at:a], z
        want[i] = (kept + text[at:], [tuple(s) for s in spans])
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in S.dedup(df, line_words=1).collect()}
    assert got == want and sum(bool(s) for _, s in want.values()) > 30
