"""Sharding by an exact uniform shuffle: a hypergeometric communication matrix says how many rows each partition sends to each cell of a shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, unused

#: Rows of a cell, the part of a shard that one task puts in order.
CELL_ROWS = 1 << 14
#: Populations from this size on are beyond numpy's own draws.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """Number of good ones among take drawn without replacement.

    Large populations are drawn by inversion: the law's ratios around its mode, 12 standard deviations far, need no factorials.
    """
    if good < LARGE and bad < LARGE:
        return int(rng.hypergeometric(good, bad, take))
    low, high = max(0, take - bad), min(good, take)
    mode = min(max((take + 1) * (good + 1) // (good + bad + 2), low), high)
    share, n = good / (good + bad), good + bad
    reach = int(12 * (take * share * (1 - share) * (n - take) / max(n - 1, 1)) ** 0.5) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    ratios = np.log(good - x) + np.log(take - x) - np.log(x + 1) - np.log(bad - take + x + 1)
    logs = np.r_[0.0, np.cumsum(ratios)]
    mass = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(mass, rng.random() * mass[-1], "right"))


def spread_draw(rng: np.random.Generator, room: np.ndarray, take: int) -> np.ndarray:
    """How many of take places, drawn without replacement from all room, lie in each cell."""
    total = int(room.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(room, take, method="marginals")
    if len(room) == 1:
        return np.array([take], np.int64)
    half = len(room) // 2
    left = int(room[:half].sum())
    goes = hypergeometric(rng, left, total - left, take)
    return np.r_[spread_draw(rng, room[:half], goes), spread_draw(rng, room[half:], take - goes)]


def matrix_row(seed: int, counts: np.ndarray, room: np.ndarray, part: int) -> np.ndarray:
    """The row of partition part in the matrix with row sums counts and column sums room.

    Partitions are halved again and again, and each half draws its share of the room that is left. The draw of a half is seeded by its
    bounds, so every task finds its own row, and all rows fit together, without the matrix being anywhere as a whole.
    """
    upto = np.r_[0, np.cumsum(counts)]
    lo, hi = 0, len(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = spread_draw(np.random.default_rng([seed, lo, hi]), room, int(upto[mid] - upto[lo]))
        lo, hi, room = (lo, mid, left) if part < mid else (mid, hi, room - left)
    return room


def shard_sizes(n: int, shards: int) -> np.ndarray:
    """Sizes of the shards, at most one apart."""
    return n // shards + (np.arange(shards) < n % shards)


def shuffled(rows: DataFrame, shards: int, *, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """rows in a uniformly random order, cut into shards whose sizes are at most one apart; adds shard, from 0, and slot, gapless from 0 in each shard.

    Each partition is counted, permuted on its own as the matrix says, exchanged by (shard, block of cell_rows slots), and each such cell is permuted again.
    Columns of rows stay in the JVM; Python sees row counts. The driver holds a count for each partition, a task its partition's cell numbers and a
    number for each cell. rows must be read twice alike: a scan of files or a saved table, not the outcome of a shuffle; a partition that has
    another count the second time is an error. Then reruns, and tasks that a lost executor ran, agree.

    Decided cases: a row is placed by its place in the files, whatever it holds, so nulls, empty and long texts, repeated rows and hot groups are dealt
    like all others; fewer rows than shards leave shards empty; an empty table gives no rows; columns named shard or slot are replaced, whatever
    their case, all others kept.
    """
    kept = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    counted = rows.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each partition
    counts = np.zeros(max((r.part for r in counted), default=-1) + 1, np.int64)
    for r in counted:
        counts[r.part] = r.n
    sizes = shard_sizes(int(counts.sum()), shards)
    blocks = max(1, -(-int(sizes.max()) // cell_rows))
    room = np.clip(sizes[:, None] - np.arange(blocks) * cell_rows, 0, cell_rows).ravel()

    def deal(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        n = int(counts[part]) if part < len(counts) else 0
        rng = np.random.default_rng([seed, 1, part])
        cells = rng.permutation(np.repeat(np.arange(len(room), dtype=np.int32), matrix_row(seed, counts, room, part))) if n else np.empty(0, np.int32)
        at = 0
        for batch in batches:
            own = cells[at : at + len(batch)]
            if len(own) < len(batch):
                break
            at += len(batch)
            yield pd.DataFrame({"shard": own // blocks, "block": own % blocks, "pri": rng.integers(1 << 62, size=len(own)), "at": (part << 40) + np.arange(at - len(own), at)})
        else:
            if at == n:
                return
        raise ValueError(f"partition {part} had {n} rows when it was counted: give rows as files or a saved table")

    cell, block, at, number = (unused(x, rows) for x in ("cell_", "block_", "at_", "number_"))
    udf = F.pandas_udf(deal, "shard int, block int, pri long, at long").asNondeterministic()
    dealt = rows.select(*[F.col(f"`{c}`") for c in kept], udf(F.lit(1)).alias(cell))
    dealt = dealt.select(*[F.col(f"`{c}`") for c in kept], F.col(cell)["shard"].alias("shard"), F.col(cell)["block"].alias(block), F.struct(F.col(cell)["pri"], F.col(cell)["at"]).alias(at))
    place = F.row_number().over(Window.partitionBy("shard", block).orderBy(at))
    slot = F.col(block).cast("long") * cell_rows + F.col(number) - 1
    return dealt.withColumn(number, place).select(*[F.col(f"`{c}`") for c in kept], "shard", slot.alias("slot"))


def write_shards(dealt: DataFrame, path: str) -> None:
    """Files under path/shard=N; a file's rows are in order of slot, cell by cell. They are written where they were ordered, without another exchange."""
    dealt.write.mode("errorifexists").partitionBy("shard").parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffled(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
