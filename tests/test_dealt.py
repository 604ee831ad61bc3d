"""Rows of edits are dealt over as many partitions as they ask for, with the same results."""

import pytest
from pyspark.sql import functions as F

from keyloom import schema, spread
from keyloom.operators import browse
from keyloom.operators import upsert as U
from keyloom.operators import views

NOW = "2024-05-05T00:00:00Z"


def state(spark):
    ids = spark.range(1, 301)
    key = lambda m: F.concat(F.lit("k"), (F.col("id") % m).cast("string"))
    lines = ids.select("id", F.lit("2020").alias("ts"), F.array(key(3), key(5)).alias("keys"), F.concat(F.lit("v"), "id").alias("value"), F.lit(0).cast("long").alias("ord"))
    fact = lambda m, n: ids.where(f"id % {m} = 0").select("id", F.lit("2020").alias("ts"), F.lit("h").alias("hash"), key(n).alias("key"), F.col("id").alias("ord"))
    clock = ids.where("id % 4 = 0").select("id", F.lit("2020").alias("ts"))
    return schema.State(lines, fact(17, 3).drop("key"), fact(11, 3), fact(13, 5), clock, clock)


def edits(spark):
    return spark.range(1, 201).select("id", "id", F.array(F.lit("new"), F.lit("-k1"), F.lit("k0")).alias("keys")).toDF("id", "seq", "keys")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


CHANGES = [
    lambda s: U.edit_state(s, edits(s.lines.sparkSession), NOW),
    lambda s: U.untag_state(s, "k1", NOW),
    lambda s: U.delete_under_state(s, "k1", NOW),
    lambda s: U.delete_ids_state(s, s.lines.where("id % 9 = 0").select("id"), NOW),
]


@pytest.mark.parametrize("change", CHANGES)
def test_tables_are_the_same_when_dealt(spark, change, monkeypatch):
    plain = [rows(df) for df in change(state(spark))]
    monkeypatch.setattr(spread, "WHOLE_ROWS", 50)
    monkeypatch.setattr(spread, "PART_ROWS", 25)
    assert [rows(df) for df in change(state(spark))] == plain


def test_partitions_follow_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "WHOLE_ROWS", 50)
    monkeypatch.setattr(spread, "PART_ROWS", 25)
    s = state(spark)
    assert U.update_keys(s.lines, s.tomb, s.ktomb, edits(spark))[0].rdd.getNumPartitions() == 20  # 300 lines and 200 edits


def test_last_of_equal_and_null_numbers(spark):
    told = [(1, 5, ["a", "-a"]), (2, None, ["a"]), (2, 3, ["-a"]), (3, 3, ["a"]), (3, None, ["-a"]), (4, None, ["a", "-a"]), (5, 2, ["-a"]), (5, 9, ["A"])]
    last = U.last_edits(spark.createDataFrame(told, "id long, seq long, keys array<string>"))
    assert {(r.id, r.op, r.seq, r.ever) for r in last.collect()} == {(1, "detach", 5, True), (2, "detach", 3, True), (3, "attach", 3, True), (4, "detach", None, True), (5, "attach", 9, True)}


def test_a_page_orders_only_its_links(spark):
    s = state(spark)
    page = browse.newest(s.lines, s.tomb, s.ktomb, limit=3)
    assert rows(page) == rows(browse.timeline(views.shown(s.lines, s.tomb, s.ktomb), limit=3))
    # The lines that are ordered are those of the page alone.
    first = page._jdf.queryExecution().optimizedPlan().toString().split("Window [")[1]
    assert "LeftSemi" in first
