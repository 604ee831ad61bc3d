"""Change facts: export of a state, and how facts find their record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, ts_next_second
from ..schema import State
from ..spread import spread_join
from . import views

#: Facts of one replica that are ordered together.
RUN = 4096


def export_a(state: State) -> DataFrame:
    """(id, true_ts, ts, hash, keys, value) of live records: first value, visible keys, and the time that they survive with."""
    shown = views.shown(state.lines, state.tomb, state.ktomb)
    first = views.first_link(shown)
    clocks = views.effective_clocks(state.lines, state.mts, state.sts).select("id", "survival_ts")
    return first.join(clocks, "id").select("id", F.col("ts").alias("true_ts"), F.col("survival_ts").alias("ts"), content_hash(F.col("value")).alias("hash"), "keys", "value")


def export_c(exported: DataFrame) -> DataFrame:
    """(id, true_ts, hash): the true time of records that travel with a later one."""
    return exported.where(F.col("ts") != F.coalesce("true_ts", F.lit(""))).select("id", F.coalesce("true_ts", F.lit("")).alias("true_ts"), "hash")


def export_m(state: State) -> DataFrame:
    """(id, head, value): further links of live records with the value that names the record."""
    alive = views.live(state.lines, state.tomb)
    head = F.first("value").over(views.by_id())
    return alive.withColumn("head", head).withColumn("place", F.row_number().over(views.by_id())).where("place > 1").select("id", "head", "value")


def export_dkt(state: State) -> DataFrame:
    """(verb, ts, hash, key) of tombstones and attachments that have a hash."""
    none = F.lit(None).cast("string")
    d = state.tomb.where("hash <> ''").select(F.lit("D").alias("verb"), "ts", "hash", none.alias("key"))
    k, t = (x.where("hash <> ''").select(F.lit(v).alias("verb"), "ts", "hash", "key") for x, v in ((state.ktomb, "K"), (state.katt, "T")))
    return d.unionByName(k).unionByName(t)


def export(state: State) -> DataFrame:
    """All facts with their section: A with C and M, then D, K, T."""
    a = export_a(state)
    none, no_keys = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    rows = [
        a.select(F.lit(0).alias("section"), "id", F.lit(1).alias("place"), F.lit("A").alias("verb"), "ts", none.alias("hash"), none.alias("key"), "keys", "value"),
        export_c(a).select(F.lit(0).alias("section"), "id", F.lit(0).alias("place"), F.lit("C").alias("verb"), F.col("true_ts").alias("ts"), "hash", none.alias("key"), no_keys.alias("keys"), none.alias("value")),
        export_m(state).select(F.lit(0).alias("section"), "id", F.lit(2).alias("place"), F.lit("M").alias("verb"), none.alias("ts"), content_hash(F.col("head")).alias("hash"), none.alias("key"), no_keys.alias("keys"), "value"),
        export_dkt(state).select(F.array_position(F.array(*map(F.lit, "DKT")), F.col("verb")).cast("int").alias("section"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("place"), "verb", "ts", "hash", "key", no_keys.alias("keys"), none.alias("value")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def as_text(exported: DataFrame) -> DataFrame:
    """(section, id, place, line): facts as lines of text."""
    e = lambda c: F.coalesce(c, F.lit(""))
    line = (
        F.when(F.col("verb") == "A", F.concat_ws("|", F.lit("A"), e("ts"), F.array_join("keys", " "), e("value")))
        .when(F.col("verb") == "M", F.concat(F.lit("M|"), e("hash"), F.lit("|"), e("value")))
        .when(F.col("verb").isin("K", "T"), F.concat_ws("|", "verb", e("ts"), e("hash"), e("key")))
        .otherwise(F.concat_ws("|", "verb", e("ts"), e("hash")))
    )
    return exported.select("section", "id", "place", line.alias("line"))


def survival_raise(del_ts: Column, edit_ts: Column, line_ts: Column, survival_ts: Column) -> Column:
    """The time with which a record travels on that an edit saved from a delete: a second after it, the edit's at most.

    Null where nothing is raised: no edit after the delete, or the line or an earlier survival is later already.
    """
    e = lambda c: F.coalesce(c, F.lit(""))
    raised = F.least(ts_next_second(del_ts), edit_ts)
    return F.when((edit_ts > del_ts) & (raised > e(line_ts)) & (raised > e(survival_ts)), raised)


def true_times(facts: DataFrame) -> DataFrame:
    """Facts with true_ts: for an A line the time of the C line before it, if that is the last A or C before it and names the record.

    The last A or C before a fact is sought inside runs of RUN sequence numbers first and then over the runs, so that one
    replica's stream is not ordered in one task.
    """
    clock = F.when(F.col("verb").isin("A", "C"), F.struct("verb", "ts", "hash"))
    rows = facts.withColumn("run", F.floor(F.col("seq") / RUN)).withColumn("clock", clock)
    near = Window.partitionBy("replica", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.where("clock IS NOT NULL").groupBy("replica", "run").agg(F.max_by("clock", "seq").alias("run_last"))
    over = Window.partitionBy("replica").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    every = rows.select("replica", "run").distinct().join(runs, ["replica", "run"], "left")
    carried = every.withColumn("carry", F.last("run_last", True).over(over)).select("replica", "run", "carry")
    out = rows.withColumn("before", F.last("clock", True).over(near)).join(carried, ["replica", "run"])
    last = F.coalesce("before", "carry")
    paired = (F.col("verb") == "A") & (last["verb"] == "C") & (last["hash"] == F.col("hash"))
    return out.withColumn("true_ts", F.when(F.col("verb") == "A", F.when(paired, last["ts"]).otherwise(F.col("ts")))).drop("run", "clock", "before", "carry")


def import_links(lines: DataFrame, tomb: DataFrame, facts: DataFrame, hash_of=content_hash) -> DataFrame:
    """Lines with the further links that M facts (seq, hash, value) bring.

    A link is attached if any link of a live record has the hash and no record, live or dead, has the value; of several records that a value
    is told for the first one gets it. The link has its record's keys and no time of its own. Importing the same facts again changes nothing.
    """
    told = facts.where("verb = 'M' AND value <> ''").select("seq", "hash", "value").join(lines.select("value").distinct(), "value", "left_anti")
    heads = lines.groupBy(hash_of(F.col("value")).alias("hash")).agg(F.min("id").alias("id"))
    heads = heads.join(tomb.select("id").distinct(), "id", "left_anti")
    owned = told.join(heads, "hash").groupBy("value").agg(F.min(F.struct("seq", "id")).alias("f")).select("value", "f.seq", "f.id")
    tops = lines.groupBy("id").agg(F.max("ord").alias("top"), F.min_by("keys", F.struct("ord", "value")).alias("keys"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("seq", "value"))
    new = owned.join(tops, "id").select("id", F.lit("").alias("ts"), "keys", "value", (F.col("top") + place).alias("ord"))
    return lines.select("id", "ts", "keys", "value", "ord").unionByName(new)


def link_heads(facts: DataFrame, hash_of=content_hash) -> DataFrame:
    """(link, head): the record that each further link's hash stands for."""
    return facts.where("verb = 'M'").groupBy(hash_of(F.col("value")).alias("link")).agg(F.min("hash").alias("head"))


def resolved(facts: DataFrame, hash_of=content_hash) -> DataFrame:
    """Facts with rec, the hash of their record, through any of its links. Facts of one busy record are dealt over tasks."""
    heads = link_heads(facts, hash_of).withColumnRenamed("link", "hash")
    return spread_join(facts, heads, ["hash"], ["replica", "seq"], "left").withColumn("rec", F.coalesce("head", "hash")).drop("head")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Facts without replays. A fact is told by all that it says, its keys in any order and its true time included, where that is known already
    (true_times comes first: a C line is told from its place in one replica's stream).
    """
    said = [c for c in ("verb", "hash", "key", "ts", "true_ts", "value") if c in facts.columns]
    one = facts.groupBy(*said, F.array_sort("keys").alias("sorted_keys")).agg(F.min(F.struct("replica", "seq", "keys")).alias("f"))
    return one.select("f.replica", "f.seq", *said, "f.keys")
