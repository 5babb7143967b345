"""Word splitting, hashing and windows against regular expressions; wavelet matrix and FM-index against scans."""

import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import decontaminate as D
from metroscope.llm import words as W

TEXT = st.text(alphabet=st.sampled_from("aB9 \t\n.-é数  z"), max_size=40)


def _strings(w, n):
    raw = w.buf.tobytes()
    return [[raw[w.start[j]:w.end[j]].decode() for j in range(w.first[i], w.first[i + 1])] for i in range(n)]


@settings(max_examples=120, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_split_equals_regular_expressions(texts):
    column = pa.array(texts, pa.string())
    assert _strings(W.split(column, "space"), len(texts)) == [H.SPACE.findall(t) for t in texts]
    assert _strings(W.split(column, "alnum"), len(texts)) == [H.ALNUM.findall(H.low(t)) for t in texts]


def test_hashes_tell_words_apart_and_know_equal_ones():
    words = sorted({f"w{i}" * (1 + i % 5) for i in range(5000)} | {"a" * n for n in range(1, 60)})
    w = W.split(pa.array([" ".join(words), " ".join(reversed(words))]), "space")
    h = w.hashes()
    assert len(np.unique(h)) == len(words)
    assert (h[:len(words)] == h[len(words):][::-1]).all()


@pytest.mark.parametrize("k", [1, 2, 5, 10, 50])
def test_windows_are_equal_exactly_where_words_are(k):
    rng = np.random.default_rng(3)
    items = rng.integers(0, 3, 400).astype(np.uint64)
    h = W.windows(W.mix(items), k, 1)
    assert len(h) == 400 - k + 1
    by = {}
    for i in range(len(h)):
        assert by.setdefault(items[i:i + k].tobytes(), h[i]) == h[i]
    assert len(set(by.values())) == len(by)
    assert len(W.windows(W.mix(items[:k - 1]), k, 1)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 6), max_size=60), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=5))
def test_fm_index_finds_every_occurrence(text, phrases):
    seq = np.array([*text, 0])
    assert D.suffix_array(seq).tolist() == sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
    index = D.FMIndex(seq, 7, every=4)
    table = np.zeros((len(phrases), 4), np.int64)
    for i, p in enumerate(phrases):
        table[i, :len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if text[i:i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_wavelet_matrix_access_and_rank():
    seq = np.random.default_rng(1).integers(0, 37, 500)
    m = D.WaveletMatrix(seq, 37)
    assert (m.access(np.arange(500)) == seq).all()
    at = np.array([0, 1, 250, 500])
    for s in (0, 5, 36):
        assert m.rank(np.full(4, s), at).tolist() == [(seq[:i] == s).sum() for i in at]
