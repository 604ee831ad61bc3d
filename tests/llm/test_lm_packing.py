"""What crosses the network between the tasks of LM scoring: whole, and small."""

import numpy as np

from keyloom.llm import lm_scoring as lm


def test_trigrams_return_whole_and_smaller_than_eleven_bytes_each():
    rng = np.random.default_rng(1)
    words = rng.integers(16, 2**63, 60, np.int64).astype(np.uint64) << np.uint64(1)
    for n, docs in ((1, 1), (2, 1), (5_000, 3_000), (40_000, 30_000)):
        w, b, bb = (words[np.minimum(rng.zipf(1.3, n), 60) - 1] for _ in range(3))
        doc = (rng.integers(0, docs, n) << 1 | rng.integers(0, 2, n)).astype(np.uint16)
        o = np.lexsort((bb & lm._LOW32, b & lm._LOW40, w))
        w, b, bb, doc = w[o], b[o], bb[o], doc[o]
        body = lm._pack(w, b, bb, doc)
        want = w, b & lm._LOW40, bb & lm._LOW32, doc >> 1, doc & 1
        own, before, second, b_word, bb_pair, trio, told, learn = lm._unpack(body)
        got = own[b_word[bb_pair[trio]]], before[bb_pair[trio]], second[trio], told, learn
        assert all((x == y).all() and len(x) == n for x, y in zip(got, want, strict=True))
        assert n < 5_000 or len(body) < 7 * n


def test_counts_and_places_return_whole():
    n = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert (lm._counts(b"x" + lm._small(n) + b"y", 7, 1)[0] == n).all() and lm._counts(b"x" + lm._small(n), 7, 1)[1] == 1 + 7 + 12
    for x in ([], [5], list(range(0, 1000, 3)), list(range(1000))):
        held = lm._places(np.array(x, np.int64), 1000)
        at, end = lm._of_places(b"z" + held, len(x), 1000, 1)
        assert list(at) == x and end == 1 + len(held)
