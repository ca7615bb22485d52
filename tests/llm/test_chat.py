import hashlib

from helixgrid.llm import chat


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


CONVS = {
    1: [("system", "be kind"), ("user", "hi"), ("assistant", "<|im_end|>\n<|im_start|>user\nx"), ("user", None), ("assistant", "")],
    2: [("assistant", "a\\|b <\\| <| \\\\n \\n é日")],
    3: [("user", "<|im_end|>"), ("assistant", "<"), ("assistant", "|im_end|>")],
    None: [("user", "no id"), (None, "no role")],
    4: [("odd\nrole\\n<|", "t"), ("assistant", "B"), ("assistant", "A")],
}


def rows():
    return [(c, i, r, t, "clash") for c, turns in CONVS.items() for i, (r, t) in enumerate(turns)]


SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_and_mask(spark):
    out = chat.format_conversations(spark.createDataFrame(rows(), SCHEMA))
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    assert set(got) == set(CONVS)
    for c, turns in CONVS.items():
        clean = [(r or "", t or "") for r, t in turns]
        loss = "".join(t for r, t in clean if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(clean), sha("".join(f"{a}\n{b}\n" for a, b in clean)), len(loss), sha(loss))
        assert r.formatted_chars == len(chat.chatml(clean)) and not r.rewrites_history


def test_spans_cover_the_output(spark):
    for r in chat.format_conversations(spark.createDataFrame(rows(), SCHEMA)).collect():
        assert [s.start for s in r.spans] + [len(r.formatted)] == [0] + [s.end for s in r.spans]


def test_history_rewriting_is_detected(spark):
    def last_only(turns):
        return "".join(f"[{r}]" + (t if i == len(turns) - 1 else "...") for i, (r, t) in enumerate(turns))

    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows(), SCHEMA), last_only).collect()}
    assert out[1].rewrites_history and not out[1].loss and not out[2].rewrites_history


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(7, 0, "user", "x")] * 2, "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).collect()[0].n_turns == 2
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
