"""Exact top-k inner product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors of one block, queries of one block, bins of a histogram (a power of two), and blocks of queries that a task meets.
BLOCK_ROWS, QUERY_ROWS, BINS, HELD = 2048, 1024, 1 << 8, 64
_LONG = 2**63 - 1


def quantised(vectors: DataFrame, vec: str, scale: int) -> DataFrame:
    """(vec_id, dim, q): components floor(scale * x) as doubles; rows that take no part go."""
    x = F.transform(F.col(vec), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & fine).select("vec_id", F.size(vec).alias("dim"), x.alias("q"))


def _blocks(rows: DataFrame, most: int, names: tuple[str, str, str], low: str | None = None) -> DataFrame:
    """Rows packed to blocks of one dimension: dim, ids and the matrix as bytes, under the names given; with low, that column as bytes too."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for dim, own in frame.groupby("dim"):
                for at in range(0, len(own), most):
                    part = own.iloc[at : at + most]
                    matrix = np.concatenate([np.asarray(q, np.float64) for q in part["q"]]) if dim else np.empty(0)
                    out = dict(zip(names, ([int(dim)], [part["vec_id"].to_numpy(np.int64).tobytes()], [matrix.tobytes()]), strict=True))
                    yield pd.DataFrame(out | ({low: [part[low].to_numpy(np.int64).tobytes()]} if low else {}))

    dim, ids, matrix = names
    return rows.mapInPandas(pack, f"{dim} int, {ids} binary, {matrix} binary" + (f", {low} binary" if low else ""))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, queries by rows; beyond the range of a long they are held at its ends."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = a.astype(object).astype(object)
    exact = np.array([[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in exact], object).reshape(len(a), len(b))
    return np.clip(exact, -_LONG, _LONG).astype(np.int64)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, matrix, query ids, query matrix, lows) of every block of vectors that meets a block of queries of its dimension."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row]  # noqa: B023, E731
            dim = get("dim").as_py()
            if dim == get("q_dim").as_py():
                ids, qid, lo = (np.frombuffer(get(c).as_buffer(), np.int64) for c in ("ids", "q_ids", "lo"))
                matrix, wanted = (np.frombuffer(get(c).as_buffer(), np.float64).reshape(n, dim) for c, n in (("matrix", len(ids)), ("q_matrix", len(qid))))
                yield ids, matrix, qid, wanted, lo


def _histograms(blocks: DataFrame, queries: DataFrame, shift: int, bins: int, k: int) -> DataFrame:
    """(query_id, value, n): counts of all scores in so many bins of 2 ** shift from a query's lo on, value being the bin's least score.

    A task counts all scores of its cells. Of its counts it tells those from the highest bin down to the one that holds its own kth
    score: the kth of all is no lower.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for ids, matrix, qid, wanted, lo in _cells(batches):
            key = qid.tobytes()
            if key not in held and len(held) == HELD:
                yield from map(told, held.values())
                held.clear()
            counts = held.setdefault(key, (qid, lo, np.zeros((len(qid), bins), np.int32)))[2]
            score = _scores(wanted, matrix)
            place = (score.view(np.uint64) - lo.view(np.uint64)[:, None]) >> np.uint64(shift)
            able = (qid[:, None] != ids[None, :]) & (score >= lo[:, None]) & (place < bins)
            row, col = np.nonzero(able)
            counts += np.bincount(row * bins + place[row, col].astype(np.int64), minlength=counts.size).reshape(counts.shape)
        yield from map(told, held.values())

    def told(part: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
        qid, lo, counts = part
        above = np.cumsum(counts[:, ::-1], 1, np.int64)[:, ::-1] - counts
        row, place = np.nonzero((counts > 0) & (above < k))
        value = lo[row] + (place << shift)
        return pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(value), pa.array(counts[row, place].astype(np.int64))], ["query_id", "value", "n"])

    return blocks.crossJoin(queries).mapInArrow(run, "query_id long, value long, n long")


def _found(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of scores of lo or more; of a cell, a query's k best by score and then smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix, qid, wanted, lo in _cells(batches):
            score = _scores(wanted, matrix)
            row, col = np.nonzero((qid[:, None] != ids[None, :]) & (score >= lo[:, None]))
            order = np.lexsort((ids[col], -score[row, col], row))
            row, col = row[order], col[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[nth < k], col[nth < k]
            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(ids[col]), pa.array(score[row, col])], ["query_id", "vec_id", "score"])

    return blocks.crossJoin(queries).mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, *, vec: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best other rows of each query row by integer inner product, exactly.

    Queries are the rows whose vec_id is divisible by every. Histograms of all scores locate each query's kth value: the first spans
    all scores that there can be in BINS bins, each further one the kth value's bin of the one before, until a bin is one
    score; a last pass filters by that value and ties go to the smaller vec_id. A pass is one scan of the blocks of vectors against the blocks of
    queries, which the optimiser broadcasts if they are below its bound and else fetches block by block; vectors are never shuffled.

    Returns query_id, rank, vec_id, score. Decided cases: vectors null or holding null, NaN or infinite components, and rows
    with a null vec_id, take no part; vectors of other lengths are no candidates of a query; fewer candidates than k are all
    returned; rows that repeat a vec_id are candidates each, but none of a query with that id; other columns are ignored; an
    empty table gives no rows.
    """
    rows = quantised(vectors.select("vec_id", vec), vec, scale)
    blocks = saved(_blocks(rows, BLOCK_ROWS, ("dim", "ids", "matrix")), "topk-blocks")
    # Of rows that repeat a query's id with other vectors, the one that comes first in order is asked.
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "q")).alias("v")).select("vec_id", "v.*")
    asked = saved(asked, "topk-queries")
    parts = -(-asked.count() // (QUERY_ROWS * HELD)) or 1
    largest = F.max(F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))
    dim, component = rows.agg(F.coalesce(F.max("dim"), F.lit(0)), F.coalesce(largest, F.lit(0.0))).first()
    bound = min(int(component) ** 2 * dim, _LONG)

    def located(histogram: DataFrame, need: DataFrame | None) -> DataFrame:
        """Per query the largest value at which the running count from above reaches what is needed."""
        n = histogram.groupBy("query_id", "value").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
        run = n.withColumn("run", F.sum("n").over(down))
        run = run.withColumn("need", F.lit(k)) if need is None else run.join(need, "query_id")
        hit = F.max(F.when(F.col("run") >= F.col("need"), F.struct("value", "run", "n", "need")))
        at = run.groupBy("query_id").agg(F.coalesce(hit, F.min(F.struct("value", "run", "n", "need"))).alias("at"))
        # need: how many of the k best the kth value's bin must give.
        return at.select("query_id", F.col("at.value").alias("lo"), (F.col("at.need") - F.col("at.run") + F.col("at.n")).alias("need"))

    def packed(low: DataFrame | None) -> DataFrame:
        own = asked.withColumn("lo", F.lit(-bound).cast("long")) if low is None else asked.join(low.select(F.col("query_id").alias("vec_id"), "lo"), "vec_id")
        return _blocks(own.repartition(parts), QUERY_ROWS, ("q_dim", "q_ids", "q_matrix"), "lo")

    low, shift = None, (2 * bound).bit_length()
    while shift:
        bits = min(shift, BINS.bit_length() - 1)
        shift -= bits
        low = saved(located(_histograms(blocks, packed(low), shift, 1 << bits, k), None if low is None else low.select("query_id", "need")), "topk-bins")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = _found(blocks, packed(low), k)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
