import pytest

from helixgrid.llm import byte_bpe
from helixgrid.llm.queries import public_ranks

TEXTS = [
    "", None, "a", " ", "   x", "hello  world\n\n x's 123 !!?", "é" * 50, "ab" * 400, " " * 300, "x \n\t y" * 60,
    "The quick brown fox. " * 40, "word " * 80 + "z" * 200 + " tail words here " * 30, "日本語テキスト " * 40, "a\n\n\nb " * 70, "the same", "the same",
]


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (50, 49), (32_768, 2_048)])
def test_equals_whole_text_encoding(spark, chunk, overlap):
    ranks, pattern = public_ranks()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, token_ids string")
    out = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(df, ranks, pattern, chunk_chars=chunk, overlap_chars=overlap), ranks))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got == {i: byte_bpe.brute_force(t, ranks, pattern) for i, t in enumerate(TEXTS)}


def test_repeated_rows_and_empty_table(spark):
    ranks, pattern = public_ranks()
    df = spark.createDataFrame([(1, "w " * 300)] * 3, "doc_id long, text string")
    out = byte_bpe.encode(df, ranks, pattern, chunk_chars=64, overlap_chars=16).collect()
    assert len(out) == 3 and len({bytes(r.token_ids) for r in out}) == 1
    assert byte_bpe.encode(df.limit(0), ranks, pattern).count() == 0
