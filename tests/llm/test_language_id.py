import pyarrow as pa
from pyspark.sql import functions as F

from helixgrid.llm import language_id as L

WORDS = {"xx": "lorem ipsum dolor sit amet elit", "yy": "quick brown foxes jump over dogs", "zz": "été ñandú über straße çà même"}


def docs(spark, n=40):
    rows = [(i * 10 + j, " ".join((WORDS[k].split() * 3)[i % 5 :]), k, "s") for i in range(n) for j, k in enumerate(WORDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_predicts_held_out_rows(spark):
    df = docs(spark)
    out = L.predict(df, L.train(df, ~L.held_out()), keep=("lang",))
    assert out.filter(L.held_out()).count() > 5 and out.filter("lang <> lang_pred or score < 0.9").count() == 0


def test_grams_equal_plain_python():
    texts = ["Ab c", "", "..", "x", "éa-b", "end"]
    (b,) = L.blocks(pa.array(texts))
    value, own = L.grams(b.data, b.offsets)
    got = [[int(v).to_bytes(8, "big")[4:] for v, o in zip(value, own, strict=True) if o == i] for i in range(len(texts))]
    for t, g in zip(texts, got, strict=True):
        folded = b" ".join(bytes(c if c > 127 or chr(c).isalpha() else 32 for c in t.lower().encode()).split())
        line = b" " + folded + b"   "
        assert g == ([line[i : i + 4] for i in range(len(folded) + 1)] if folded else [])


def test_defined_cases(spark):
    df = docs(spark)
    model = L.train(df, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !! —"), (4, "日本語"), (5, "dolor"), (5, "dolor"), (6, "lorem " * 50_000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in L.predict(odd, model).orderBy("doc_id").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (5, "xx"), (5, "xx"), (6, "xx")]
    nothing = L.train(df.limit(0), F.lit(True))
    assert {r.lang_pred for r in L.predict(odd, nothing).collect()} == {"und"}
    assert L.predict(odd.limit(0), model).count() == 0


def test_known_marks_are_no_letters(spark):
    rows = [(i, "— “ ” — " * 5 + ("lorem" if i < 20 else "été"), "xx") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "— “ ” —"), (2, "été — “"), (3, "— lorem —")], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in L.predict(odd, L.train(df, F.lit(True))).orderBy("doc_id").collect()]
    assert got == [(1, "und", False), (2, "xx", True), (3, "xx", True)]


def test_scores_equal_plain_python(spark):
    model = L.train(docs(spark), F.lit(True), slot_bits=7)  # so full that false answers are many
    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & full
        return x ^ (x >> 31)

    def brute(text):
        letters = "".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in text)
        words = " ".join(letters.split(" ")).split()
        if not words or not any(c.isalpha() for c in text):
            return "und", 0.0
        line = (" " + " ".join(words) + "   ").encode()
        grams = [int.from_bytes(line[i : i + 4], "big") for i in range(len(line) - 3)]
        best, score = model.usual, 0.0
        for i, (name, f) in enumerate(zip(model.languages, model.false_rate, strict=True)):
            have = sum(all(int(model.slots[0][mix((g + 0x9E3779B97F4A7C15 * (j + 1)) & full) >> (64 - 7)]) >> i & 1 for j in range(L.HASHES)) for g in grams)
            fair = max(0.0, (have - len(grams) * f) / (1 - f))
            if fair / len(grams) > score + 1e-12:
                best, score = name, fair / len(grams)
        return best, min(1.0, score)

    for text in ["dolor sit", "Quick, BROWN foxes!", "été", "zzz qq", "dolor quick", "日本", "12", "", "lorem " * 30 + "over dogs " * 31, "x"]:
        name, score = L.score_text(text.encode(), model)
        want = brute(text)
        assert (name, round(score, 9)) == (want[0], round(want[1], 9)), text
    assert any(f > 0.01 for f in model.false_rate)
