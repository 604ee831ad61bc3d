"""What an edit leaves for replicas: whole rows of tombstones, key facts and clocks."""

from pyspark.sql import functions as F

from keyloom import schema
from keyloom.functions.text import content_hash
from keyloom.operators import upsert as U

NOW = "2024-05-05T00:00:00Z"
OLD = "2020-01-01T00:00:00Z"


def state(spark):
    make = spark.createDataFrame
    lines = make([(i, OLD, ["a", "b"], f"v{i}", i) for i in (1, 2, 3)], schema.LINES)
    ktomb = make([(1, OLD, "h1", "a", 7), (2, OLD, "h2", "a", 8)], schema.KEY_FACTS)
    katt = make([(1, OLD, "h1", "b", 9), (3, OLD, "h3", "b", 9)], schema.KEY_FACTS)
    clock = make([(1, OLD), (3, OLD)], schema.CLOCK)
    return schema.State(lines, make([(3, OLD, "h3", 5)], schema.TOMB), ktomb, katt, clock, clock)


def hash_of(spark, value):
    return spark.range(1).select(content_hash(F.lit(value))).first()[0]


def rows(df):
    return {tuple(r) for r in df.select([c for c in ("id", "key", "ts", "hash") if c in df.columns]).collect()}


def test_edits_travel(spark):
    edits = spark.createDataFrame([(1, 1, ["a", "-b"]), (2, 1, ["-a"]), (3, 1, ["a"])], "id long, seq long, keys array<string>")
    out, h1 = U.edit_state(state(spark), edits, NOW), hash_of(spark, "v1")
    assert rows(out.ktomb) == {(2, "a", OLD, "h2"), (1, "b", NOW, h1)}
    assert rows(out.katt) == {(1, "a", NOW, h1), (3, "b", OLD, "h3")}
    assert rows(out.mts) == {(1, NOW), (2, NOW), (3, OLD)}


def test_untag_and_delete_under_travel(spark):
    out = U.untag_state(state(spark), "b", NOW)
    assert rows(out.ktomb) == {(1, "a", OLD, "h1"), (2, "a", OLD, "h2")} | {(i, "b", NOW, hash_of(spark, f"v{i}")) for i in (1, 2, 3)}
    assert rows(out.katt) == set() and rows(out.mts) == {(1, NOW), (2, NOW), (3, OLD)}
    out = U.delete_under_state(state(spark), "b", NOW)
    assert rows(out.tomb) == {(i, NOW, hash_of(spark, f"v{i}")) for i in (1, 2, 3)} and out.tomb.count() == 3
    assert rows(out.katt) == rows(out.mts) == rows(out.sts) == set()
