"""Comparison of replicas by digests of ranges: what is equal is never moved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import saved
from .merge import differences

#: Bits of the ranges' numbers, level by level; of the first level at most 2^12 rows go to all tasks.
LEVELS = (12, 24)


def _hash(rows: DataFrame, seed: int) -> Column:
    """A hash of a whole row. Names are hashed with the values and nulls are marked, so a value that moves to another column changes it."""
    return F.xxhash64(F.lit(seed), *[c for name in sorted(rows.columns) for c in (F.lit(name), F.col(f"`{name}`").isNull(), F.col(f"`{name}`"))])


def _range(rows: DataFrame, bits: int) -> Column:
    return F.shiftrightunsigned(_hash(rows, 0), 64 - bits)


def digests(rows: DataFrame, bits: int) -> DataFrame:
    """(range, n, sum, xor): digests of the rows whose hash begins with each number of so many bits, as partial sums before their shuffle.

    Two ranges with equal rows, in any order, have equal digests. Others are told apart by the number of rows, a sum of hashes and an exclusive or of other ones.
    """
    hashed = rows.select(_range(rows, bits).alias("range"), _hash(rows, 1).alias("h"), _hash(rows, 2).alias("g"))
    return hashed.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum"), F.bit_xor("g").alias("xor"))


def differing(a: DataFrame, b: DataFrame, bits: int) -> DataFrame:
    """The ranges whose digests differ, or that one side has alone."""
    both = digests(a, bits).alias("a").join(digests(b, bits).alias("b"), "range", "full")
    same = F.coalesce((F.col("a.n") == F.col("b.n")) & (F.col("a.sum") == F.col("b.sum")) & (F.col("a.xor") == F.col("b.xor")), F.lit(False))
    return both.where(~same).select("range")


def within(rows: DataFrame, ranges: DataFrame, bits: int) -> DataFrame:
    """The rows of ranges; those of other ranges stay where they are."""
    known = F.broadcast(ranges) if bits <= LEVELS[0] else ranges
    return rows.withColumn("range_", _range(rows, bits)).join(known.withColumnRenamed("range", "range_"), "range_", "left_semi").drop("range_")


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other has not, with the side, as differences tells them; rows are counted as often as they occur.

    Digests of 2^12 ranges are compared first, then those of 2^24 ranges inside the ones that differ, and only rows of ranges that still differ meet. So equal replicas exchange digests only,
    and others their differences and what shares a range with them. A side is read once for each level; a range that differs but has equal digests is missed with a probability of about 2^-128.
    The columns of both sides must be the same.
    """
    for bits in LEVELS:
        ranges = saved(differing(a, b, bits), "ranges")
        a, b = within(a, ranges, bits), within(b, ranges, bits)
    return differences(a, b)
