import math
import random
import zlib

import numpy as np
import pandas as pd

from keyloom.llm import toxicity as T


def corpus(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randint(0, 400)}" for _ in range(40)]
        bad = rnd.random() < 0.3
        if bad:
            words += rnd.sample(["idiot", "scum", "moron", "trash"], 2)
        if rnd.random() < (0.6 if bad else 0.1):  # neutral mentions go along with insults
            words.append(rnd.choice(["muslim", "christian"]))
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_held_out_accuracy_and_neutral_mentions(spark):
    rows = corpus(1500, 1)
    docs, labels = frames(spark, rows)
    truth = {i: y for i, _, y in rows}
    out = [r for r in T.toxicity(docs, labels).collect() if r.held_out]
    assert len(out) > 200 and sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    neutral = spark.createDataFrame([(1, "w1 w2 muslim w3"), (2, "w1 w2 hindu w3"), (3, "w1 w2 w3")], "doc_id long, text string")
    model = T.fit(T.training_rows(docs, labels, 5, 0, 20_000))
    scores = model.scores([r.text for r in neutral.orderBy("doc_id").collect()])
    assert (scores < 0.5).all()


def test_swaps_lower_the_pull_of_identity_terms(spark, monkeypatch):
    docs, labels = frames(spark, corpus(1500, 2))
    rows = T.training_rows(docs, labels, 5, 0, 20_000)
    gap = lambda m: abs(m.weights.get(T.key_of("muslim"), 0.0))
    with_penalty = gap(T.fit(rows))
    monkeypatch.setattr(T, "SWAP_WEIGHT", 0.0)
    assert with_penalty < gap(T.fit(rows))


def test_bound_on_rows_and_repeats(spark):
    docs, labels = frames(spark, corpus(200, 3))
    rows = T.training_rows(docs.union(docs), labels.union(labels), 5, 0, 50)
    assert len(rows) == 50
    a = T.fit(rows)
    b = T.fit(T.training_rows(docs.union(docs), labels.union(labels), 5, 0, 50))
    assert a == b


def test_nulls_empties_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (None, "x", 3.0), (2, "", 2.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None)], "doc_id long, toxic int")
    rows = T.toxicity(docs, none).collect()
    assert len(rows) == 4 and len({r.score for r in rows}) == 1 and all(r.score < 0.1 and r.predicted == 0 for r in rows)
    assert T.toxicity(docs.where("false"), none).count() == 0
    assert T.fit(pd.DataFrame({"toxic": []})).bias == T.NOTHING_KNOWN


def test_columns_of_other_names(spark):
    docs, labels = frames(spark, corpus(300, 4))
    odd = docs.selectExpr("*", "1 AS lower", "2 AS label_id", "3 AS toxic", "4 AS score", "5 AS x")
    out = T.toxicity(odd, labels)
    assert out.columns == ["doc_id", "text", "lower", "label_id", "toxic", "x", "score", "held_out", "predicted"]
    want = {r.doc_id: r.score for r in T.toxicity(docs, labels).collect()}
    assert all((r.lower, r.label_id, r.toxic, r.x) == (1, 2, 3, 5) and r.score == want[r.doc_id] for r in out.collect())


def brute_fit(rows):
    """The same objective on a dense matrix, by plain gradient descent to the end."""
    words = sorted({w for _, t, _ in rows for w in T.tokens(t)})
    x = np.array([[w in T.tokens(t) for w in words] for _, t, _ in rows], float)
    y = np.array([b for *_, b in rows], float)
    n, total, bad = len(y), x.sum(0), x.T @ y
    rate = np.clip(total / n, 1e-9, 1 - 1e-9)
    z = (bad / y.sum() - (total - bad) / (n - y.sum())) / np.sqrt(rate * (1 - rate) * (1 / y.sum() + 1 / (n - y.sum())))
    keep = (total >= T.MIN_TEXTS) & (np.abs(z) >= T.MIN_Z)
    x, words = x[:, keep], [w for w, k in zip(words, keep, strict=True) if k]
    at = {w: i for i, w in enumerate(words)}
    swapped = []
    for _, t, _ in rows:
        for out, new in T.swaps(T.tokens(t)):
            d = np.zeros(len(words))
            for ws, sign in ((out, -1), (new, 1)):
                for w in ws:
                    if w in at:
                        d[at[w]] += sign
            swapped.append(d)
    swapped = np.array(swapped).reshape(-1, len(words))
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, b = np.zeros(len(words)), 0.0
    for _ in range(60_000):
        err = weight * (1 / (1 + np.exp(-(x @ w + b))) - y)
        pull = 2 * T.SWAP_WEIGHT * swapped.T @ (swapped @ w) / len(swapped) if len(swapped) else 0
        w, b = w - 0.05 * (x.T @ err + T.RIDGE * w + pull), b - 0.05 * err.sum()
    return dict(zip(words, w, strict=True)), b


def test_scores_against_a_dense_fit(spark, monkeypatch):
    monkeypatch.setattr(T, "RIDGE", 0.02)  # so that both fits come to rest
    monkeypatch.setattr(T, "PASSES", 3000)
    rows = corpus(240, 6)
    docs, labels = frames(spark, rows)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 0]
    weights, bias = brute_fit(learnt)
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels).collect()}
    for i, text, _ in rows:
        want = 1 / (1 + math.exp(-(bias + sum(weights.get(w, 0) for w in T.tokens(text)))))
        assert abs(got[i] - want) < 1e-3


def test_very_long_text(spark):
    docs, labels = frames(spark, corpus(300, 5))
    long = spark.createDataFrame([(10_000, "idiot " + " ".join(f"z{i}" for i in range(200_000)))], docs.schema)
    rows = {r.doc_id: r for r in T.toxicity(docs.union(long), labels.union(spark.createDataFrame([(10_000, 1)], labels.schema))).collect()}
    assert len(rows) == 301 and 0 <= rows[10_000].score <= 1
