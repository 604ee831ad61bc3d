"""Merging facts of many replicas under last-write-wins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, key_encode
from ..sources.readers import latest_bundles, parse_facts, payload_lines
from ..scratch import saved
from ..spread import spread_join
from .facts import RUN, resolved, true_times


class Merged(NamedTuple):
    """records (rec, value, add_ts, del_ts, live), keys (rec, key) and links (rec, value) of live records."""

    records: DataFrame
    keys: DataFrame
    links: DataFrame


def converge(facts: DataFrame, hash_of=content_hash) -> Merged:
    """The state that all replicas end in, whatever order facts arrive in.

    A record lives if its latest addition is later than its latest delete. Key sets described before the delete don't
    come back: a key counts if a surviving addition carries it or an attachment is later than the delete, and it is seen
    if its latest attachment, by true time, is later than its latest detachment. Ties delete and detach. Two aggregations with partial sums and one join.
    Facts that have a true_ts keep it.
    """
    timed = facts if "true_ts" in facts.columns else true_times(facts)
    # What follows passes over the facts several times; their order and records are found once.
    known = saved(resolved(timed, hash_of).withColumn("ts", F.coalesce("ts", F.lit(""))).select("rec", "replica", "seq", "verb", "ts", "true_ts", "key", "keys", "value"), "converge")
    is_ = lambda v: F.col("verb") == v
    dead = known.groupBy("rec").agg(
        F.max(F.when(is_("A"), F.col("ts"))).alias("add_ts"),
        F.max(F.when(is_("D"), F.col("ts"))).alias("del_ts"),
        F.min(F.when(is_("A"), F.col("value"))).alias("value"),
    )
    live = F.col("add_ts").isNotNull() & F.coalesce(F.col("add_ts") > F.col("del_ts"), F.lit(True))
    records = saved(dead.withColumn("live", live).select("rec", "value", "add_ts", "del_ts", "live"), "converge-records")

    told = spread_join(known.where(F.col("verb").isin("A", "K", "T")), records.where("live").select("rec", "del_ts"), ["rec"], ["replica", "seq"])
    stays = (F.col("verb") == "K") | F.coalesce(F.col("ts") > F.col("del_ts"), F.lit(True))
    names = F.when(is_("A"), F.col("keys")).otherwise(F.array("key"))
    each = told.where(stays).select("rec", "verb", "ts", "true_ts", F.explode(names).alias("key")).withColumn("key", key_encode(F.col("key")))
    times = each.groupBy("rec", "key").agg(
        F.max(F.when(is_("A"), F.coalesce("true_ts", F.lit(""))).when(is_("T"), F.col("ts"))).alias("att"),
        F.max(F.when(is_("K"), F.col("ts"))).alias("det"),
    )
    keys = times.where(F.col("att").isNotNull() & F.coalesce(F.col("att") > F.col("det"), F.lit(True))).select("rec", "key")
    links = known.where(is_("M")).select("rec", "value").distinct().join(records.where("live").select("rec"), "rec", "left_semi")
    return Merged(records, keys, links)


def replay(facts: DataFrame, hash_of=content_hash) -> DataFrame:
    """(rec, live, ts, keys): facts applied in stream order, record by record, as one replica would that starts empty.

    Order matters here and early deletes are forgotten, but what a run of facts does to a record is told by the maximum of its stamps alone: from the first
    addition on a record is what its latest stamp says, where a delete wins a tie. So runs of RUN facts are summed up first, the runs before a fact then tell the
    state that it meets, and a record with any part of all facts is folded in many tasks. Its keys are those since it last came back: of each the latest stamp decides,
    and a detachment wins a tie. What happens to keys while a record is dead is lost.
    """
    place = F.struct("replica", "seq")
    rows = resolved(true_times(facts), hash_of).select(
        "rec", "replica", "seq", "verb", F.coalesce("ts", F.lit("")).alias("ts"), "true_ts", key_encode(F.col("key")).alias("key"), F.transform("keys", key_encode).alias("keys")
    )
    rows = saved(rows.where(F.col("verb").isin("A", "D", "K", "T")), "replay")
    is_a = F.col("verb") == "A"
    firsts = rows.where(is_a).groupBy("rec").agg(F.min(place).alias("first"))
    since = saved(spread_join(rows, firsts, ["rec"], ["replica", "seq"]).where(place >= F.col("first")).drop("first"), "replay-since")

    stamped = since.where(F.col("verb").isin("A", "D")).select("rec", "replica", "seq", "verb", "ts", F.struct("ts", (~is_a).alias("gone")).alias("stamp"), F.floor(F.col("seq") / RUN).alias("run"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    runs = stamped.groupBy("rec", "replica", "run").agg(F.max("stamp").alias("top"))
    carried = runs.select("rec", "replica", "run", F.max("top").over(before.partitionBy("rec").orderBy("replica", "run")).alias("carry"))
    met = stamped.withColumn("near", F.max("stamp").over(before.partitionBy("rec", "replica", "run").orderBy("seq", "verb", "ts"))).join(carried, ["rec", "replica", "run"])
    met = met.withColumn("met", F.greatest("near", "carry"))
    new = is_a & (F.col("met").isNull() | (F.col("ts") > F.col("met.ts")))
    heads = met.groupBy("rec").agg(
        F.max("stamp").alias("top"), F.max(F.when(new, F.col("ts"))).alias("ts"), F.max(F.when(new & F.coalesce("met.gone", F.lit(True)), place)).alias("born"),
    )
    heads = saved(heads.select("rec", (~F.col("top.gone")).alias("live"), "ts", "born"), "replay-heads")

    told = spread_join(since.where("verb <> 'D'"), heads.where("live").select("rec", "born"), ["rec"], ["replica", "seq"]).where(place >= F.col("born"))
    when = F.when(is_a, F.coalesce(F.nullif("true_ts", F.lit("")), "ts")).otherwise(F.col("ts"))
    each = told.select("rec", F.struct(when.alias("ts"), (F.col("verb") == "K").alias("gone")).alias("stamp"), F.explode(F.when(is_a, F.col("keys")).otherwise(F.array("key"))).alias("key"))
    last = each.where("key IS NOT NULL").groupBy("rec", "key").agg(F.max("stamp").alias("stamp")).where("NOT stamp.gone")
    keys = last.groupBy("rec").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return heads.join(keys, "rec", "left").select("rec", "live", "ts", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def place_documents(bodies: DataFrame) -> DataFrame:
    """(replica, path, placed): where each replica's body goes. bodies: (replica, path, body).

    Bodies with the same name and bytes are one; of different bytes under one name the first replica keeps it, and the
    others get their hash in the name.
    """
    tagged = bodies.withColumn("tag", F.md5("body")).drop("body")
    firsts = tagged.groupBy("path", "tag").agg(F.min("replica").alias("by"))
    holder = firsts.groupBy("path").agg(F.min_by("tag", F.struct("by", "tag")).alias("held"))
    stem, ext = F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^./]*)?$", 2)
    named = tagged.join(holder, "path")
    placed = F.when(F.col("tag") == F.col("held"), F.col("path")).otherwise(F.concat(stem, F.lit("~"), F.substring("tag", 1, 16), ext))
    return named.select("replica", "path", placed.alias("placed"))


def remap_values(rows: DataFrame, placed: DataFrame, secret: str = "aisc:@") -> DataFrame:
    """Rows (replica, value, ...) with values that name a moved body, also inside a secret's marker."""
    marked = F.col("value").startswith(secret)
    bare = F.when(marked, F.substring("value", len(secret) + 1, 1 << 20)).otherwise(F.col("value"))
    moved = placed.select("replica", F.col("path").alias("bare"), "placed").distinct()
    out = rows.withColumn("bare", bare).join(moved, ["replica", "bare"], "left")
    new = F.when(marked, F.concat(F.lit(secret), "placed")).otherwise(F.col("placed"))
    return out.withColumn("value", F.coalesce(new, "value")).drop("bare", "placed")


def folder_report(bundles: DataFrame, own: str | None = None) -> DataFrame:
    """One row of what a folder of checked bundles (nonce, status) holds of other devices: seen, took, newer, bad."""
    others = bundles if own is None else bundles.where(F.coalesce(F.col("nonce") != own, F.lit(True)))
    return others.agg(F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "took"), ("newer", "newer"), ("damaged", "bad"))])


def folder_facts(bundles: DataFrame, import_time: str) -> DataFrame:
    """The facts that the latest valid bundle of each device tells; replica and seq are its device and line."""
    told = parse_facts(payload_lines(latest_bundles(bundles)), import_time).where("status = 'fact'")
    hashed = F.when(F.col("verb") == "A", content_hash(F.col("value"))).otherwise(F.col("hash"))
    return told.select("replica", "seq", "verb", "ts", hashed.alias("hash"), "key", "keys", "value")


def merge_folder(bundles: DataFrame, own: DataFrame | None, import_time: str) -> Merged:
    """A folder pass: the facts of every device's latest valid bundle, and own facts, converged."""
    facts = folder_facts(bundles, import_time)
    return converge(facts if own is None else facts.unionByName(own))


def normal_state(merged: Merged) -> DataFrame:
    """(value, keys) of live records, without ids."""
    keys = merged.keys.groupBy("rec").agg(F.array_join(F.array_sort(F.collect_list("key")), " ").alias("keys"))
    return merged.records.where("live").join(keys, "rec", "left").select("value", F.coalesce("keys", F.lit("")).alias("keys"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other has not, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
