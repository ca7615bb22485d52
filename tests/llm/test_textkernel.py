import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from helixgrid.llm import textkernel as K

TEXT = st.text(alphabet=st.sampled_from("ab \n\tAé日."), max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6), st.integers(1, 4), st.sampled_from([7, 1 << 20]))
def test_words_and_shingles_equal_plain_python(texts, k, limit):
    want = [[tuple(w[i : i + k]) for i in range(len(w) - k + 1)] for w in (re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts)]
    got, names = [[] for _ in texts], {}
    for b in K.blocks(pa.array(texts), limit):
        w = K.words(b.data, b.offsets)
        h = K.word_hashes(b.data, w.starts, w.ends)
        s, first = K.shingles(h, w.text, k)
        for value, at in zip(s.tolist(), first, strict=True):
            words = tuple(bytes(b.data[w.starts[j] : w.ends[j]]).decode() for j in range(at, at + k))
            got[b.first + w.text[at]].append(words)
            assert names.setdefault(value, words) == words
    assert got == want
    assert len(set(names.values())) == len(names)


def test_nulls_slices_and_large_types():
    a = pa.array(["skip", None, "x y", ""], pa.large_string()).slice(1)
    (b,) = K.blocks(a)
    assert b.offsets.tolist() == [0, 0, 3, 3] and np.array_equal(K.words(b.data, b.offsets).bounds, [0, 0, 2, 2])
    assert not list(K.blocks(pa.array([], pa.string())))
