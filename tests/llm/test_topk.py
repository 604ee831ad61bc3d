import math
import random

import pytest

from keyloom.llm import topk_search as K


def brute(rows, k, every):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q and len(b) == len(a)))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    monkeypatch.setattr(K, "QUERY_ROWS", 3)
    monkeypatch.setattr(K, "HELD", 2)
    rnd = random.Random(seed)
    base = [rnd.uniform(-1, 1) for _ in range(6)]
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)] if i % 3 else base) for i in range(400)]
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, [0.5, 0.5]), (1201, [0.5, -0.5]), (None, base), (1250, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in K.top_k(frame, k=5, every=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = {q: v for q, v in brute(rows, 5, 50).items() if v}
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want


def test_large_values_and_few_candidates(spark):
    rows = [(0, [3e6, 1.0]), (1, [2e6, -1.0]), (2, [2e6, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r.vec_id, r.score) for r in K.top_k(frame, k=5, every=50).orderBy("rank").collect()]
    want = brute(rows, 5, 50)[0]
    assert got == [(n + 1, i, s) for n, (i, s) in enumerate(want)]


def test_columns_of_other_names(spark):
    rows = [(i, [float(i), 1.0]) for i in range(4)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = plain.selectExpr("*", "1 AS dim", "2 AS q", "3 AS lo", "4 AS ids", "5 AS rank", "6 AS score", "7 AS query_id")
    assert sorted(map(tuple, K.top_k(odd).collect())) == sorted(map(tuple, K.top_k(plain).collect()))


def test_repeated_ids(spark):
    frame = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [3.0]), (1, [4.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.query_id, r.vec_id, r.score) for r in K.top_k(frame).collect())
    assert got == [(1, 0, 1, 256 * 1024), (2, 0, 1, 256 * 768)]


def test_empty(spark):
    assert K.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
