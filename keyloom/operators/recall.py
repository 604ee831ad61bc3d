"""Recall by key set algebra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, key_encode
from ..schema import State
from ..scratch import saved
from . import views


def _asked(keys: list[str], most: int | None) -> Column:
    return F.array_distinct(F.array(*[key_encode(F.lit(k)) for k in keys[:most]]))


def recall(lines: DataFrame, keys: list[str], mode: str = "all", after: int | None = None, limit: int | None = None, most: int | None = None) -> DataFrame:
    """Ids filed under all (or any) of keys, from lines with ekeys; a narrow filter, then distinct ids.

    An unknown or empty key gives nothing: all of them becomes empty, any of them goes on without it. With most,
    keys beyond so many are not looked at (QUERY_KEYS is the format's own bound). A page is what follows the id `after`, `limit` rows of it.
    """
    has = [F.array_contains("ekeys", key_encode(F.lit(k))) for k in keys[:most]]
    if not has:
        hits = F.lit(False)
    else:
        hits = reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), has)
    out = lines.where(hits).select("id").distinct()
    return page(out, after, limit)


def recall_state(state: State, keys: list[str], mode: str = "all", after: int | None = None, limit: int | None = None, most: int | None = None) -> DataFrame:
    """The same from a state that is not indexed: a detachment only takes keys away, so lines are filtered before they meet tombstones."""
    coded = F.transform("keys", key_encode)
    has = [F.array_contains(coded, key_encode(F.lit(k))) for k in keys[:most]]
    may = reduce((lambda a, b: a & b) if mode == "all" else (lambda a, b: a | b), has) if has else F.lit(False)
    rows = state.lines.where(may) if after is None else state.lines.where(may & (F.col("id") > after))
    return recall(views.shown(rows, state.tomb, state.ktomb), keys, mode, None, limit, most)


def recall_postings(postings: DataFrame, keys: list[str], mode: str = "all", most: int | None = None) -> DataFrame:
    """The same from postings, which need only the asked keys' rows."""
    asked = postings.where(F.array_contains(_asked(keys, most), F.col("key")))
    if mode == "any":
        return asked.select("id").distinct()
    return asked.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size(_asked(keys, most))).select("id")


def page(ids: DataFrame, after: int | None, limit: int | None) -> DataFrame:
    """Keyset page: ids above after, in order; limit None or below 1 is all."""
    if after is not None:
        ids = ids.where(F.col("id") > after)
    return ids.orderBy("id").limit(limit) if limit and limit > 0 else ids


def recall_batch(postings: DataFrame, queries: DataFrame, mode: str = "all", most: int | None = None) -> DataFrame:
    """(qid, id) of many queries (qid, keys) at once by an equi-join on the key."""
    keys = F.array_distinct(F.transform(F.slice("keys", 1, most) if most else F.col("keys"), key_encode))
    asked = queries.select("qid", keys.alias("asked")).select("qid", F.size("asked").alias("need"), F.explode("asked").alias("key"))
    hits = asked.join(postings, "key")
    if mode == "any":
        return hits.select("qid", "id").distinct()
    return hits.groupBy("qid", "id", "need").agg(F.count(F.lit(1)).alias("n")).where("n = need").select("qid", "id")


def resolve(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per link of each id in store order; an id without lines keeps an empty value."""
    return ids.join(lines.select("id", "ord", "value"), "id", "left").select("id", F.coalesce("ord", F.lit(0)).alias("ord"), F.coalesce("value", F.lit("")).alias("value"))


def with_tags(ids: DataFrame, postings: DataFrame) -> DataFrame:
    """Each id with its keys, the busiest first: (id, tags)."""
    busy = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    keys = ids.join(postings, "id").join(busy, "key")
    return keys.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key")))["key"].alias("tags"))


def find_values(lines: DataFrame, values: DataFrame) -> DataFrame:
    """(value, id) of values that a record holds."""
    return lines.join(values.select("value").distinct(), "value").groupBy("value").agg(F.min("id").alias("id"))


def find_hashes(lines: DataFrame, hashes: DataFrame, hash_of=content_hash) -> DataFrame:
    """(hash, id) of hashes that a record's value has, the first record of each."""
    held = lines.select(hash_of(F.col("value")).alias("hash"), "id")
    return held.join(hashes.select("hash").distinct(), "hash").groupBy("hash").agg(F.min("id").alias("id"))


def key_cat(postings: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """For each key in the order given, the values filed under it: (pos, id, ord, value)."""
    asked = F.posexplode(F.array(*[key_encode(F.lit(k)) for k in keys]))
    listed = lines.sparkSession.range(1).select(asked.alias("pos", "key"))
    return postings.join(F.broadcast(listed), "key").join(lines, "id").where("value <> ''").select("pos", "id", "ord", "value")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id").distinct(), "id", "left_anti")


def set_contains(a: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, has): whether the set holds each of ids."""
    return ids.select("id").distinct().join(a.select("id", F.lit(True).alias("has")).distinct(), "id", "left").withColumn("has", F.coalesce("has", F.lit(False)))


def set_add(a: DataFrame, ids: DataFrame) -> DataFrame:
    return a.select("id").union(ids.select("id")).distinct()


def numbered(rows: DataFrame, order: list[str], start: int, out: str = "id") -> DataFrame:
    """Consecutive numbers after start in the order given, without sorting all rows in one task.

    Rows are range-partitioned once and written down; each partition's count gives the next one's offset.
    """
    # Their number follows the data: adaptive execution joins small ranges and leaves large ones.
    spread = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "numbered")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.join(F.broadcast(counts.select("part", "offset")), "part").withColumn(out, inside + F.col("offset") + start).drop("part", "offset")
