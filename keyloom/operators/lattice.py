"""A merged state from which all facts can be told again: the greatest times that facts gave to a name and to its keys.

Rows are kept under the name that facts call a record by, and names meet through links when the state is read. So states merge by maxima alone, in any
order and grouping, also where a link later takes a name over for another record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, key_encode
from ..scratch import saved
from ..spread import spread_join
from .facts import as_text, true_times
from .merge import Merged, converge, folder_facts

#: kind is A (added at ts, with its value), D (deleted), K (key detached), T (key attached at ts), S (key attached truly at `at`, in a line that survives deletes
#: before ts) or M (link is a further link). ts is the greatest for all other columns alike.
LATTICE = "hash string, kind string, key string, at string, link string, ts string, value string"
_ONE = "struct<kind:string,key:string,at:string,link:string,ts:string,value:string>"
#: An M line follows all A lines of its record.
_LAST = 1 << 30


def partials(facts: DataFrame) -> DataFrame:
    """Facts as rows of a lattice, not yet merged. Facts that have a true_ts keep it; else C lines tell it, each in its own replica's stream."""
    timed = facts if "true_ts" in facts.columns else true_times(facts)
    ts, none = F.coalesce("ts", F.lit("")), F.lit(None).cast("string")

    def one(kind, key=none, at=none, link=none, ts=ts, value=none):
        kind = kind if not isinstance(kind, str) else F.lit(kind)
        return F.struct(kind.alias("kind"), key.alias("key"), at.alias("at"), link.alias("link"), ts.alias("ts"), value.alias("value")).cast(_ONE)

    at = F.coalesce("true_ts", F.lit(""))
    plain = at == ts
    carried = F.transform("keys", lambda k: one(F.when(plain, "T").otherwise("S"), key=key_encode(k), at=F.when(~plain, at)))
    is_ = lambda v: F.col("verb") == v
    rows = (
        F.when(is_("A"), F.concat(F.array(one("A", value=F.col("value"))), F.coalesce(carried, F.array().cast(f"array<{_ONE}>"))))
        .when(is_("M"), F.array(one("M", link=F.col("value"), ts=F.lit(""))))
        .when(is_("D"), F.array(one("D")))
        .when(F.col("verb").isin("K", "T"), F.array(one(F.col("verb"), key=key_encode(F.col("key")))))
    )
    return timed.select("hash", F.explode(rows).alias("one")).select("hash", "one.*")


def reduced(rows: DataFrame) -> DataFrame:
    """Rows of one or more lattices as one: partial maxima before the shuffle, so a busy record is spread. Of S rows of a key the dominated go:
    another one is as late and was truly attached later.
    """
    one = rows.groupBy("hash", "kind", "key", "at", "link").agg(F.max("ts").alias("ts"), F.min("value").alias("value"))
    later = Window.partitionBy("hash", "key").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    carried = one.where("kind = 'S'").withColumn("later", F.max("ts").over(later)).where("later IS NULL OR ts > later").drop("later")
    return one.where("kind <> 'S'").unionByName(carried).select(*[c.split()[0] for c in LATTICE.split(", ")])


def lattice(facts: DataFrame) -> DataFrame:
    """The lattice of facts, as a table."""
    return saved(reduced(partials(facts)), "lattice")


def joined(*parts: DataFrame) -> DataFrame:
    """The lattice of all that the parts know. The order of the parts, and parts that say the same, make no difference."""
    return saved(reduced(reduce(DataFrame.unionByName, parts)), "lattice")


def as_facts(rows: DataFrame) -> DataFrame:
    """Rows as facts with true times. seq is a hash, by which facts of a busy record are dealt over tasks."""
    verb = F.when(F.col("kind") == "S", "A").otherwise(F.col("kind"))
    keys = F.when(F.col("kind") == "S", F.array("key")).when(F.col("kind") == "A", F.array().cast("array<string>"))
    return rows.select(
        F.lit("").alias("replica"), F.xxhash64("kind", "key", "at", "link").alias("seq"), verb.alias("verb"), F.when(F.col("kind") != "M", F.col("ts")).alias("ts"), "hash",
        F.when(F.col("kind").isin("K", "T"), F.col("key")).alias("key"), keys.alias("keys"), F.coalesce("link", "value").alias("value"), F.coalesce("at", F.when(verb == "A", F.col("ts"))).alias("true_ts"),
    )


def state(rows: DataFrame, hash_of=content_hash) -> Merged:
    """The converged state of a lattice; that of all facts that went into it."""
    return converge(as_facts(rows), hash_of)


def told(rows: DataFrame) -> DataFrame:
    """(section, id, place, verb, ts, hash, key, keys, value): what a replica tells after a merge, so that whoever merges it knows all that this one does.

    id is the record's name; lines go out in order of section, id and place. A record that lives under its name has an A line with its latest time and the keys attached just then, a C and an A line for
    keys that truly are older than the line that carried them past a delete, and M lines; then come deletes, detachments (of dead records too: they
    outlive the delete) and all other attachments that no delete has undone.
    """
    none, no_keys = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    is_ = lambda *k: F.col("kind").isin(*k)
    heads = rows.where(is_("A", "D")).groupBy("hash").agg(
        F.max(F.when(is_("A"), F.col("ts"))).alias("add_ts"), F.max(F.when(is_("D"), F.col("ts"))).alias("del_ts"), F.min("value").alias("named"),
    )
    stays = lambda ts: F.coalesce(F.col(ts) > F.col("del_ts"), F.lit(True))
    each = spread_join(rows.where(is_("T", "S")), heads, ["hash"], ["kind", "key", "at"], "left").where(stays("ts"))
    now = is_("T") & F.coalesce(F.col("ts") == F.col("add_ts"), F.lit(False))

    def line(df, section, place, verb, ts=none, key=none, keys=no_keys, value=none):
        return df.select(
            F.lit(section).alias("section"), F.col("hash").alias("id"), place.cast("int").alias("place"), F.lit(verb).alias("verb"),
            ts.alias("ts"), "hash", key.alias("key"), keys.alias("keys"), value.alias("value"),
        )

    own = each.where(now).groupBy("hash").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    alive = heads.where(F.col("add_ts").isNotNull() & stays("add_ts")).join(own, "hash", "left")
    carried = each.where(is_("S")).groupBy("hash", "ts", "at").agg(F.array_sort(F.collect_list("key")).alias("keys"), F.min("named").alias("named"))
    carried = carried.withColumn("g", F.row_number().over(Window.partitionBy("hash").orderBy("ts", "at")))
    parts = [
        line(alive, 0, F.lit(0), "A", F.col("add_ts"), keys=F.coalesce("keys", F.array().cast("array<string>")), value=F.col("named")),
        line(carried, 0, 2 * F.col("g") - 1, "C", F.col("at")),
        line(carried, 0, 2 * F.col("g"), "A", F.col("ts"), keys=F.col("keys"), value=F.col("named")),
        line(rows.where(is_("M")), 0, F.lit(_LAST), "M", value=F.col("link")),
        line(rows.where(is_("D")), 1, F.lit(0), "D", F.col("ts")),
        line(rows.where(is_("K")), 2, F.lit(0), "K", F.col("ts"), key=F.col("key")),
        line(each.where(is_("T") & ~now), 3, F.lit(0), "T", F.col("ts"), key=F.col("key")),
    ]
    return reduce(DataFrame.unionByName, parts)


def told_lines(rows: DataFrame) -> DataFrame:
    """(section, id, place, line): the same as lines of text."""
    return as_text(told(rows))


def folder_pass(bundles: DataFrame, own: DataFrame | None, import_time: str) -> DataFrame:
    """The lattice after a folder pass: every device's latest valid bundle, and what this device knew before. told_lines gives its next bundle's lines."""
    others = lattice(folder_facts(bundles, import_time))
    return others if own is None else joined(others, own)
