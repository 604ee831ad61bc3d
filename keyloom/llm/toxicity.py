"""Toxicity: a counterfactual-regularised linear classifier."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, saved, unused

#: The bounds on what the fit takes: labelled rows, those with the smallest hash of doc_id, and words, those that differ most between the
#: classes. Whatever the texts' lengths, the driver gets MAX_ROWS lists of at most MAX_WORDS numbers.
MAX_ROWS, MAX_WORDS = 20_000, 4096
#: Bias of a classifier that has learnt nothing.
NOTHING_KNOWN = -4.0
#: Weight of the squared change of score under a swap, of the ridge, passes of the fit; texts
#: a word must be in, and standard errors by which its rates in the two classes must differ, to have a weight.
SWAP_WEIGHT, RIDGE, PASSES, MIN_TEXTS, MIN_Z = 4.0, 1e-4, 300, 3, 4.0
#: Groups of identity terms; a swap puts every other term of the group in a term's place.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "native", "refugee"),
    ("immigrants", "natives", "refugees"),
    ("african", "european", "american", "mexican"),
    ("old", "young"),
    ("disabled", "abled"),
)
_TOKEN = re.compile(r"[^\W_]+")


def key_of(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")) >> 1


def tokens(text: str | None) -> set[str]:
    return set(_TOKEN.findall(text)) if text else set()


@dataclass
class ToxicityModel:
    """A logistic regression over the words a text has, each counted once."""

    weights: dict[int, float]
    bias: float

    def scores(self, texts: list[str | None], known: "_Weights | None" = None) -> np.ndarray:
        """Score of each (lower-cased) text; an empty text scores by the bias alone."""
        of = (_Weights(self.weights) if known is None else known).__getitem__
        z = np.array([math.fsum(map(of, tokens(t))) + self.bias for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class _Weights(dict):
    """Weight of each word met so far."""

    def __init__(self, weights: dict[int, float]):
        self.by_key = weights

    def __missing__(self, token: str) -> float:
        self[token] = w = self.by_key.get(key_of(token), 0.0)
        return w


def swaps(words: set[str]) -> list[tuple[list[str], list[str]]]:
    """(terms taken out, terms put in) of each counterfactual of a text."""
    out = []
    for group in IDENTITY_TERMS:
        here = [t for t in group if t in words]
        for new in group if here else ():
            if new not in words:
                out.append((here, [new]))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, max_rows: int, max_words: int = MAX_WORDS) -> pd.DataFrame:
    """(features, swapped, toxic) of at most max_rows labelled rows outside the held-out fold.

    Texts become hashes of their words inside the tasks; these are counted by class with a shuffle, and only the max_words of them that
    tell the classes apart best come to the driver, with the counterfactuals' words. A doc_id labelled twice counts as toxic if either
    label is; of rows that repeat a doc_id the one with the smallest hash of its words is learnt from.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(fold(F.col("doc_id"), folds) != held_out)
    marked = marked.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    rows = docs.select("doc_id", ascii_lower(F.col("text")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            words = [tokens(t) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"],
                    "toxic": frame["toxic"].astype(float),
                    "x": [np.unique([key_of(w) for w in ws]).astype(np.int64) for ws in words],
                    "gone": [[np.array([key_of(w) for w in a], np.int64) for a, _ in swaps(ws)] for ws in words],
                    "new": [[np.array([key_of(w) for w in b], np.int64) for _, b in swaps(ws)] for ws in words],
                }
            )

    out = rows.mapInPandas(featured, "doc_id long, toxic double, x array<long>, gone array<array<long>>, new array<array<long>>")
    out = out.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("x", "gone", "new"), F.xxhash64("x")).alias("f")).select("doc_id", "toxic", "f.*")
    out = saved(out, "toxicity-rows")
    n, bad = out.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    if not 0 < bad < n:
        return out.select("doc_id", "toxic").withColumns({c: F.array().cast(t) for c, t in (("x", "array<long>"), ("gone", "array<array<long>>"), ("new", "array<array<long>>"))}).toPandas()
    seen, rate = F.col("n"), F.col("n") / n
    z = (F.col("bad") / bad - (seen - F.col("bad")) / (n - bad)) / F.sqrt(rate * (1 - rate) * (1 / bad + 1 / (n - bad)))
    counts = out.select("toxic", F.explode("x").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    telling = counts.where((seen >= MIN_TEXTS) & (seen < n)).withColumn("z", F.abs(z)).where(F.col("z") >= MIN_Z - 1e-6)
    words = np.sort(np.array([r["word"] for r in telling.orderBy(F.desc("z"), "word").limit(max_words).select("word").collect()], np.int64))

    def known(keys: np.ndarray) -> list[int]:
        keys = np.asarray(keys, np.int64)
        return keys[np.isin(keys, words)].tolist()

    def narrowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            swapped = {c: [[known(k) for k in ks] for ks in frame[c]] for c in ("gone", "new")}
            yield frame.assign(x=[known(k) for k in frame["x"]], **swapped)

    return out.mapInPandas(narrowed, out.schema).orderBy("doc_id").toPandas()


def fit(rows: pd.DataFrame) -> ToxicityModel:
    """Minimise log loss + SWAP_WEIGHT * mean squared change of the logit under swaps + RIDGE, by gradient steps over all rows.

    The classes weigh alike. Without rows of both classes, or words that tell them apart, nothing is known against any text: every weight is 0 and the bias is far below 0.
    """
    y = rows["toxic"].to_numpy(float) if len(rows) else np.empty(0)
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, NOTHING_KNOWN)
    parts = [np.asarray(x, np.int64) for x in rows["x"]]
    flat, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    gone, new = ([np.asarray(x, np.int64) for row in rows[c] for x in row] for c in ("gone", "new"))
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum())
    # A word of few training texts, or about as frequent in both classes, says nothing; its weight stays 0. Only the other
    # words get a column, so that the passes below hold little.
    words, total = np.unique(flat, return_counts=True)
    words, total = words[total >= MIN_TEXTS], total[total >= MIN_TEXTS]
    bad_words, bad_counts = np.unique(flat[y[owner] > 0], return_counts=True)
    at = np.minimum(np.searchsorted(bad_words, words), len(bad_words) - 1)
    bad = np.where(bad_words[at] == words, bad_counts[at], 0)
    n_bad = y.sum()
    rate = np.clip(total / len(y), 1e-9, 1 - 1e-9)
    z = (bad / n_bad - (total - bad) / (len(y) - n_bad)) / np.sqrt(rate * (1 - rate) * (1 / n_bad + 1 / (len(y) - n_bad)))
    cols = words[np.abs(z) >= MIN_Z]
    if not len(cols):
        return ToxicityModel({}, NOTHING_KNOWN)

    def placed(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(cols, keys), len(cols) - 1)
        known = cols[at] == keys
        return at[known], of[known]

    x_at, owner = placed(flat, owner)
    sides = []
    for part in (gone, new):
        of = np.repeat(np.arange(len(part)), [len(p) for p in part])
        sides.append(placed(np.concatenate(part) if part else np.empty(0, np.int64), of))
    (g_at, g_of), (n_at, n_of) = sides
    lipschitz = 0.25 * (1 + float(weight @ np.bincount(owner, np.ones(len(x_at)), len(y)))) + (4 * SWAP_WEIGHT if len(gone) else 0) + RIDGE
    w = ahead = np.zeros(len(cols))
    b = b_ahead = 0.0
    for step in range(PASSES):  # Nesterov's gradient steps
        err = weight * (1 / (1 + np.exp(-np.clip(np.bincount(owner, ahead[x_at], len(y)) + b_ahead, -500, 500))) - y)
        grad = np.bincount(x_at, err[owner], len(cols)) + RIDGE * ahead
        if len(gone):
            change = np.bincount(n_of, ahead[n_at], len(gone)) - np.bincount(g_of, ahead[g_at], len(gone))
            pull = 2 * SWAP_WEIGHT * change / len(gone)
            grad += np.bincount(n_at, pull[n_of], len(cols)) - np.bincount(g_at, pull[g_of], len(cols))
        w_next, b_next = ahead - grad / lipschitz, b_ahead - err.sum() / lipschitz
        drive = step / (step + 3)
        ahead, b_ahead = w_next + drive * (w_next - w), b_next + drive * (b_next - b)
        w, b = w_next, b_next
    return ToxicityModel({int(c): float(x) for c, x in zip(cols[w != 0], w[w != 0], strict=True)}, b if w.any() else NOTHING_KNOWN)


def fold(doc_id, folds: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS) -> DataFrame:
    """Add held_out, score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on) to docs.

    The classifier learns from at most max_rows labelled rows outside the held-out fold; its only input is the text. Scoring is one pass
    without a shuffle; the weights that go to all tasks are those of the
    sample's words at most, at any size of data. Decided cases: null and empty texts
    score by the bias; rows that repeat score alike; labels that are null are left out; a doc_id with two labels counts as toxic if either
    is; a null doc_id has a null held_out; without labels of both classes, or words that tell them apart, all texts score alike, far
    below 0.5, as nothing is known against any of them; columns named held_out, score or
    predicted are replaced; an empty table gives no rows.
    """
    fitted = fit(training_rows(docs, labels, folds, held_out, max_rows))
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    kept = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    lower = unused("lower", docs)
    schema = docs.select(*kept).withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Weights(model.value.weights)
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            scores = model.value.scores(batch.column(lower).to_pylist(), known)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, "score"])

    scored = docs.select(*kept, ascii_lower(F.col("text")).alias(lower)).mapInArrow(run, schema)
    return scored.withColumns({"held_out": fold(F.col("doc_id"), folds) == held_out, "predicted": (F.col("score") >= 0.5).cast("int")})


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")
