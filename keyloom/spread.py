"""Joins whose key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the key space whose rows are counted to find hot keys, and rows of a part below which it is not split.
SPREAD_BUCKETS, SPREAD_ROWS = 1 << 12, 256
#: Rows of a dealt partition on average, and those below which Spark's own partitions do.
PART_ROWS, WHOLE_ROWS = 1 << 18, 1 << 21


def parts_for(*frames: DataFrame) -> int | None:
    """Partitions that the rows of all frames ask for, at least as many as Spark's own; None if they are few."""
    rows = sum(df.count() for df in frames)
    if rows <= WHOLE_ROWS:
        return None
    return max(-(-rows // PART_ROWS), int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """rows dealt by keys over parts partitions, before anything is sorted or hashed: a task's memory follows PART_ROWS, not the size of a file's split or a
    fixed number of partitions. What is joined to them on these keys is dealt alike."""
    return rows.repartition(parts, *keys) if parts else rows


def spread_join(rows: DataFrame, other: DataFrame, keys: list[str], spread: list[str], how: str = "inner", n: str | None = None) -> DataFrame:
    """rows joined to other on keys, of which a few may hold most of rows.

    Rows are counted by SPREAD_BUCKETS hashes of their keys; other may hold these numbers already, in the column n. A bucket of over four times the average is dealt over several tasks by
    the columns spread, and other's rows of that bucket go to each of these. At most a quarter more of other is sent for each of the few
    buckets that can be that large. What is broadcast has a row for a bucket at most.
    """
    bucket = lambda: F.pmod(F.xxhash64(*keys), F.lit(SPREAD_BUCKETS)).cast("int")
    counts = (other if n else rows).groupBy(bucket().alias("bucket_")).agg((F.sum(n) if n else F.count(F.lit(1))).alias("n_"))
    most = F.greatest(F.lit(SPREAD_ROWS), 4 * F.sum("n_").over(Window.partitionBy()) / SPREAD_BUCKETS)
    hot = counts.withColumn("parts_", F.ceil(F.col("n_") / most).cast("int")).where("parts_ > 1").select("bucket_", "parts_")
    parts = F.coalesce("parts_", F.lit(1))
    dealt = rows.withColumn("bucket_", bucket()).join(F.broadcast(hot), "bucket_", "left").withColumn("part_", F.pmod(F.xxhash64(*spread), parts).cast("int"))
    copies = other.withColumn("bucket_", bucket()).join(F.broadcast(hot), "bucket_", "left").withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.drop("bucket_", "parts_").join(copies.drop("bucket_", "parts_"), [*keys, "part_"], how).drop("part_")
