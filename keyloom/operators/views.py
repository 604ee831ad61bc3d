"""Views of the record tables: live links, visible keys, postings, first links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.text import key_encode


def by_id() -> WindowSpec:
    """A record's links in store order."""
    return Window.partitionBy("id").orderBy("ord", "value")


def live(lines: DataFrame, tomb: DataFrame) -> DataFrame:
    """Links of records that no tombstone names."""
    return lines.join(tomb.select("id").distinct(), "id", "left_anti")


def visible(lines: DataFrame, ktomb: DataFrame) -> DataFrame:
    """Lines with keys less the detached ones, and ekeys, their encoded forms."""
    dead = ktomb.groupBy("id").agg(F.collect_set(key_encode(F.col("key"))).alias("dead"))
    out = lines.withColumn("coded", F.transform("keys", key_encode)).join(dead, "id", "left")
    shown = F.filter("keys", lambda _, i: ~F.array_contains("dead", F.get("coded", i)))
    free = F.col("dead").isNull()
    out = out.withColumns({"ekeys": F.when(free, F.array_distinct("coded")).otherwise(F.array_except("coded", "dead")), "keys": F.when(free, F.col("keys")).otherwise(shown)})
    return out.drop("dead", "coded")


def shown(lines: DataFrame, tomb: DataFrame, ktomb: DataFrame) -> DataFrame:
    """Live links with their visible keys."""
    return visible(live(lines, tomb), ktomb)


def postings(shown_lines: DataFrame) -> DataFrame:
    """(key, id), unique. Keys belong to a record's first link."""
    return first_link(shown_lines).select(F.explode("ekeys").alias("key"), "id")


def first_link(lines: DataFrame) -> DataFrame:
    """A record's first line, with the number of further links."""
    n = F.count(F.lit(1)).over(by_id().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return lines.withColumn("place", F.row_number().over(by_id())).withColumn("extra", n - 1).where("place = 1").drop("place")


def multi_link(lines: DataFrame) -> DataFrame:
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("links")).where("links > 1")


def latest(facts: DataFrame, keys: list[str]) -> DataFrame:
    """The last entry's time for each key: (keys..., ts)."""
    return facts.groupBy(*keys).agg(F.max_by("ts", "ord").alias("ts"))


def effective_clocks(lines: DataFrame, mts: DataFrame, sts: DataFrame) -> DataFrame:
    """Per record: its line's time, and the edit and survival times that count."""
    e = lambda c: F.coalesce(c, F.lit(""))
    first = first_link(lines).select("id", "ts")
    out = first.join(mts.select("id", F.col("ts").alias("m")), "id", "left").join(sts.select("id", F.col("ts").alias("s")), "id", "left")
    return out.select("id", "ts", F.greatest(e("ts"), e("m"), e("s")).alias("edit_ts"), F.greatest(e("ts"), e("s")).alias("survival_ts"))
