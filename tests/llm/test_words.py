import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dyadic.llm import words as W

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    return re.findall(W.WORD, (text or "").translate(LOW))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB1 é-\n.Zz", max_size=40)), max_size=8))
def test_words_and_shingles_agree_with_plain_python(texts):
    data, offsets = W.strings(pa.array(texts, pa.string()))
    hashes, first = W.word_hashes(data, offsets)
    plain = [plain_words(t) for t in texts]
    assert np.diff(first).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    for n in (1, 3, 5):
        s, begin = W.shingles(hashes, first, n)
        want = [[tuple(p[k:k + n]) for k in range(max(1, len(p) - n + 1))] if p else [] for p in plain]
        assert np.diff(begin).tolist() == [len(x) for x in want]
        named = [g for x in want for g in x]
        assert len(set(zip(named, s.tolist()))) == len(set(named)) == len(set(s.tolist()))


def test_long_words_cross_segments(monkeypatch):
    texts = ["x" * 50 + " yy", "a" * 33, "", "b c " * 20]
    whole = W.word_hashes(*W.strings(pa.array(texts)))
    monkeypatch.setattr(W, "_SEGMENT", 16)
    cut = W.word_hashes(*W.strings(pa.array(texts)))
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()


def test_shapes_ignore_run_lengths():
    data, offsets = W.strings(pa.array(["Foo## BAR!! | foo", "Quux### A!! | b", "x"]))
    h, first = W.shape_hashes(data, offsets)
    assert first.tolist() == [0, 4, 8, 9]
    assert h[:4].tolist() == h[4:8].tolist() and h[8] == h[3]
