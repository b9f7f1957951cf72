import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm.anchors import sliding_min, window_anchors
from tallyframe.llm.dartminhash import bands, signatures
from tallyframe.llm.gsaca import suffix_array
from tallyframe.llm.hashing import distinct_shingles, shingles, stretches, words
from tests.llm.helpers import plain_words, shingle_set


@pytest.mark.parametrize("letters", [1, 2, 4, 50])
def test_suffix_array_equals_sorting(letters):
    r = random.Random(letters)
    for _ in range(200):
        s = [r.randint(1, letters) for _ in range(r.randint(0, 60))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_words_and_shingles_of_columns():
    texts = ["a b  c\nd e f", None, "", " x", "a b c d e f", "é z q"]
    for _, _, data, offsets in stretches(pa.array(texts).slice(0)):
        _, row = words(data, offsets)
        assert np.bincount(row, minlength=6).tolist() == [len(plain_words(t)) for t in texts]
        h, own = shingles(data, offsets)
        assert h[own == 0].tolist() == h[own == 4].tolist()
        _, own, times = distinct_shingles(data, offsets)
        assert np.bincount(own, minlength=6).tolist() == [len(shingle_set(t)) for t in texts]
        assert times.sum() == len(h)
    sliced = pa.array(texts).slice(3, 2)
    assert [(a, b) for a, b, _, _ in stretches(sliced)] == [(0, 2)]


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 500).astype(np.uint64)
    assert sliding_min(x, 7).tolist() == [int(x[i : i + 7].min()) for i in range(494)]


def test_equal_windows_share_their_anchor():
    r = np.random.default_rng(2)
    data = r.integers(97, 101, 6000).astype(np.uint8)
    data[4000:4500] = data[1000:1500]
    offsets = np.array([0, 3000, 6000])
    row, low, high, place, gram, context = window_anchors(data, offsets, 200, 50)
    of = {s: (int(g), int(p) - s) for a, b, p, g in zip(low, high, place, gram, strict=True) for s in range(a, b + 1)}
    assert sorted(of) == [*range(0, 2801), *range(3000, 5801)]
    assert all(of[s] == of[s + 3000] for s in range(1000, 1301))


@pytest.mark.parametrize(("n", "shared"), [(6, 4), (300, 240), (4000, 3600)])
def test_dartminhash_agrees_like_jaccard(n, shared):
    e = np.random.default_rng(n).integers(0, 2**63, 2 * n).astype(np.uint64)
    both = np.concatenate((e[:n], e[:shared], e[n : 2 * n - shared]))
    got = signatures(both, np.repeat([0, 1], n), np.ones(2 * n), 2, 4096)
    assert abs((got[0] == got[1]).mean() - shared / (2 * n - shared)) < 0.04


def test_dartminhash_weights_and_empty_rows():
    r = np.random.default_rng(5)
    w, e = r.uniform(0.3, 6, 200), r.integers(0, 2**63, 200).astype(np.uint64)
    v = w * r.uniform(0.5, 1.5, 200)
    got = signatures(np.concatenate((e, e)), np.repeat([0, 2], 200), np.concatenate((w, v)), 3, 4096)
    assert abs((got[0] == got[2]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.04
    assert not got[1].any()
    assert len(set(bands(got, 32).ravel().tolist())) > 64
