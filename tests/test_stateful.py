"""Streams with a record's own state, over several batches."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import merge as M
from keyloom.schema import FACTS
from keyloom.streaming import stateful, streams

T = [f"20{y}-01-01T00:00:00Z" for y in range(10, 20)]


def itself(col):
    return col


def batches_through(spark, tmp_path, batches, schema, build):
    """Each batch's rows, one run of the stream after another from the same checkpoint."""
    src, log, out = str(tmp_path / "in"), f"file://{tmp_path}/log", []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = []

        def take(batch, number, got=got):
            got.extend(batch.collect())

        q = build(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("append").foreachBatch(take).option("checkpointLocation", log).trigger(availableNow=True).start()
        q.awaitTermination()
        out.append(got)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_replay_over_batches_equals_replay(spark, tmp_path, seed):
    """C lines and links too, where a link is told before the facts that use its name."""
    rng = random.Random(seed)
    rows = [("a", 0, "A", T[0], "r0", None, ["p"], "r0"), ("a", 1, "M", None, "r0", None, None, "also")]
    for seq in range(2, 150):
        rec, verb = rng.choice(["r0", "also", "r1", "r2", "r3"]), rng.choice("AADDKKTTC")
        rows.append(("a", seq, verb, rng.choice([*T[:6], None]), rec, rng.choice("pqR") if verb in "KT" else None, rng.choice([["p"], ["Q", "r"], None]) if verb == "A" else None, rec if verb == "A" else None))
    parts = [rows[i : i + 50] for i in range(0, 150, 50)]
    state = {}
    for got in batches_through(spark, tmp_path, parts, FACTS, lambda s: stateful.replay_stream(s, itself)):
        state |= {r.rec: (r.live, r.ts, r["keys"]) for r in got}
    want = {r.rec: (r.live, r.ts, r["keys"]) for r in M.replay(spark.createDataFrame(rows, FACTS), itself).collect()}
    assert state == want and "also" not in want


def test_only_touched_records_come_out(spark, tmp_path):
    parts = [[("a", i, "A", T[0], f"r{i}", None, ["p"], f"r{i}") for i in range(5)], [("a", 9, "K", T[1], "r3", "p", None, None)]]
    got = batches_through(spark, tmp_path, parts, FACTS, lambda s: stateful.replay_stream(s, itself))
    assert [(r.rec, r.live, r["keys"]) for r in got[1]] == [("r3", True, [])]


def test_a_stale_replica_returns_only_after_the_delete_is_forgotten(spark, tmp_path):
    schema = "hash string, seq long, verb string, ts string, at timestamp"
    day = lambda n: f"2024-01-{n:02d} 00:00:00"

    def rows(*told):
        return spark.createDataFrame([(h, s, v, ts, d) for h, s, v, ts, d in told], "hash string, seq long, verb string, ts string, at string").withColumn("at", F.to_timestamp("at")).collect()

    parts = [
        rows(("x", 1, "A", "2024-01-01", day(1)), ("x", 2, "D", "2024-01-02", day(2))),
        rows(("x", 3, "A", "2024-01-01", day(3)), ("x", 4, "A", "2024-01-03", day(3)), ("y", 5, "D", None, day(3))),
        rows(("z", 6, "A", "2024-01-20", day(20))),  # the watermark passes the delete
        rows(("z", 7, "A", "2024-01-21", day(21))),
        rows(("x", 8, "A", "2024-01-01", day(21)), ("x", 9, "D", "2024-01-05", day(22)), ("x", 10, "A", "2024-01-04", day(22))),
    ]
    got = batches_through(spark, tmp_path, parts, schema, lambda s: stateful.forgetting_stream(s, "at", "1 day", 5 * 86_400_000))
    said = {r.seq: r.status for b in got for r in b}
    assert said == {1: "added", 2: "deleted", 3: "refused", 4: "added", 5: "deleted", 6: "added", 7: "added", 8: "added", 9: "deleted", 10: "refused"}


def test_a_fed_value_names_one_record(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    src = str(tmp_path / "in")
    for rows in ([("b",), ("a\r",), ("a",), (" ",)], [("a",), ("c",)], [("b",), ("c",)], [("aa",)]):
        spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(src, lineSep="\n")
        q = streams.feed(spark.readStream.text(src), ["k"], out, checkpoint=f"file://{tmp_path}/log")
        q.processAllAvailable()
        q.stop()
    assert sorted((r.id, r.value, r["keys"]) for r in streams.fed(spark, out).collect()) == [(1, "a", ["k"]), (2, "b", ["k"]), (3, "c", ["k"]), (4, "aa", ["k"])]
