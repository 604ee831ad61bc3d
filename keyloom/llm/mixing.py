"""Mixing sources to target weights, by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, word_count

_TOP = 2.0**63


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_passes: int) -> DataFrame:
    """Per source: rank, size, weight and target.

    sizes: (source, source_size, source_rows), one row per source. Sources in code point
    order, null last, take the weights in turn. The sum of all sizes is shared by
    weight; a target stops at max_passes times its source's size and the excess goes to
    the others by weight. Sources in order of size over weight reach their limit in that
    order, so running sums give the level at which sharing ends without iterating. One row per
    source is all that the unpartitioned windows see.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("src", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("src") - 1, F.lit(len(weights))) + 1)
    )
    everything = Window.partitionBy()
    full = Window.orderBy(F.col("source_size") / F.col("weight"), "src")
    before, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * max_passes
    levelled = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("place", F.row_number().over(full))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(rest))
    )
    open_ = F.col("level") * F.col("weight") <= cap
    return (
        levelled.withColumn("first_open", F.min(F.when(open_, F.col("place"))).over(everything))
        .withColumn("final", F.min(F.when(F.col("place") == F.col("first_open"), F.col("level"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("place") >= F.col("first_open"), F.col("final") * F.col("weight")).otherwise(cap).cast("double"),
        )
        .select("src", "source", "source_size", "source_rows", "weight", "target")
    )


def _running(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum of value by keys in the order given, whose first column decides the bucket.

    Bucket sums are summed over the few buckets first; each window then holds one bucket,
    so a key with a third of all rows is spread like any other.
    """
    rows = rows.withColumn("bucket", bucket)
    sums = rows.groupBy(*keys, "bucket").agg(F.sum(value).alias("bucket_sum"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "bucket", F.coalesce(F.sum("bucket_sum").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, [*keys, "bucket"]).withColumn(out, F.col("offset") + F.sum(value).over(inside)).drop("offset", "bucket")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_passes: int = 3, seed: int = 17, carry: bool = False) -> DataFrame:
    """Decide how many words of each document the mix takes.

    Every source is a queue of up to max_passes passes over its shuffled documents. A copy's
    virtual finish time is the source's words up to its end over the source's target;
    copies are put in one global order of that time and cut at the budget, the sum of all sizes.

    Returns doc_id, source, size, source_size, weight, target, taken (words, repeats counted), and
    with carry all columns of docs, in one struct named row. Decided cases: a null or blank text has size 0 and
    takes 0; null sources form one source, last in order; rows that repeat are documents of their
    own; an empty table gives no rows; extra columns, whatever their names, are dropped or, with carry, in row. Order among equal hashes
    is by doc_id and size; equal copies may swap, which changes no result but which of them is taken.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    h = F.xxhash64("doc_id", "source", "size", F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))
    base = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *kept).withColumn("h", h), "mix")

    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = saved(source_targets(sizes, weights, max_passes), "mix-targets")
    n, budget = targets.agg(F.coalesce(F.sum("source_rows"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    buckets = max(1, math.ceil(math.sqrt(n)))

    narrow = targets.withColumnRenamed("source", "its_source")
    rows = base.join(narrow, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    slot = F.least((F.col("h").cast("double") / F.lit(_TOP) * buckets).cast("long"), F.lit(buckets - 1))
    placed = saved(_running(rows, ["src"], slot, ["h", "doc_id", "size"], "size", "cum"), "mix-placed")

    def finish(copy: Column) -> Column:
        return (copy * F.col("source_size") + F.col("cum")) / F.col("target")

    # The global order of all copies, in ranges of finish time.
    live = placed.where("size > 0 AND target > 0")
    ranges = max(1, math.ceil(math.sqrt(max_passes * n)))
    copies = live.select("src", "h", "doc_id", "size", F.explode(F.array([finish(F.lit(i)) for i in range(max_passes)])).alias("finish"))
    copies = copies.withColumn("range", F.floor(F.least("finish", F.lit(2.0)) * ranges))
    run = F.sum("words").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    sums = copies.groupBy("range").agg(F.sum("size").alias("words")).withColumn("run", run)
    edge = sums.where(F.col("run") > budget).orderBy("range").select("range", (F.col("run") - F.col("words")).alias("before")).first()

    key = ["finish", "src", "h", "doc_id", "size"]
    if edge is None:  # all copies fit
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.lit(max_passes)).otherwise(0)
    else:
        inside = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
        cut = (
            copies.where(F.col("range") == edge["range"])
            .withColumn("run", F.sum("size").over(inside) + edge["before"])
            .where(F.col("run") <= budget)
            .agg(F.max(F.struct(*key)).alias("last"))
            .first()["last"]
        )

        def goes(copy: int) -> Column:
            at = finish(F.lit(copy))
            place = F.floor(F.least(at, F.lit(2.0)) * ranges)
            below = place < edge["range"]
            if cut is None:
                return below
            last = F.struct(*[F.lit(x).cast(t) for x, t in zip(cut, ("double", "int", "long", "long", "long"), strict=True)])
            return below | ((place == edge["range"]) & (F.struct(at.alias("finish"), *key[1:]) <= last))

        some = (F.col("size") > 0) & (F.col("target") > 0)
        taken = F.when(some, sum((goes(i).cast("int") for i in range(1, max_passes)), goes(0).cast("int"))).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "weight", "target", (taken * F.col("size")).cast("long").alias("taken"), *(["row"] if carry else []))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs, whatever their names."""
    rows = mix(docs, carry=True, **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    return rows.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "weight")
