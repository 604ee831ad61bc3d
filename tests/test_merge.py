"""Merging: last write wins, whatever order facts arrive in."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import merge as M
from keyloom.schema import FACTS
from keyloom.streaming import streams


def itself(col):
    return col


def facts(spark, rows, replica="r"):
    """rows: (verb, ts, hash, keys or key)."""
    out = []
    for seq, (verb, ts, rec, more) in enumerate(rows):
        out.append((replica, seq, verb, ts, rec, more if verb in "KT" else None, more.split() if verb == "A" else None, rec if verb == "A" else more if verb == "M" else None))
    return spark.createDataFrame(out, FACTS)


def state(merged):
    keys = {}
    for r in merged.keys.collect():
        keys.setdefault(r.rec, set()).add(r.key)
    return {r.rec: keys.get(r.rec, set()) for r in merged.records.where("live").collect()}


OLD, MID, NEW = "2020-01-01T00:00:00Z", "2025-01-01T00:00:00Z", "2030-01-01T00:00:00Z"


@pytest.mark.parametrize(
    ("rows", "replayed", "converged"),
    [
        ([("A", OLD, "x", ""), ("D", MID, "x", "")], False, False),
        ([("A", NEW, "x", ""), ("D", MID, "x", "")], True, True),
        ([("D", NEW, "x", ""), ("A", OLD, "x", "")], True, False),
        ([("A", OLD, "x", ""), ("D", MID, "x", ""), ("A", NEW, "x", "")], True, True),
        ([("A", OLD, "x", ""), ("D", MID, "x", ""), ("A", "2022-01-01T00:00:00Z", "x", "")], False, False),
        ([("A", MID, "x", ""), ("D", MID, "x", "")], False, False),
    ],
)
def test_order_in_one_stream(spark, rows, replayed, converged):
    f = facts(spark, rows)
    assert [r.live for r in M.replay(f, itself).collect()] == [replayed]
    assert ("x" in state(M.converge(f, itself))) is converged


def test_keys_follow_true_times(spark):
    off = [("A", "2020-01-01T00:00:00Z", "x", "work reading"), ("K", "2020-06-01T00:00:00Z", "x", "work")]
    assert state(M.converge(facts(spark, off), itself)) == {"x": {"reading"}}
    with_c = [*off, ("C", "2020-01-01T00:00:00Z", "x", ""), ("A", "2021-01-01T00:00:00Z", "x", "work reading")]
    assert state(M.converge(facts(spark, with_c), itself)) == {"x": {"reading"}}
    without = [*off, ("A", "2021-01-01T00:00:00Z", "x", "work reading")]
    assert state(M.converge(facts(spark, without), itself)) == {"x": {"work", "reading"}}
    foreign = [*off, ("C", "2020-01-01T00:00:00Z", "y", ""), ("A", "2021-01-01T00:00:00Z", "x", "work reading")]
    assert state(M.converge(facts(spark, foreign), itself)) == {"x": {"work", "reading"}}
    again = [*off, ("T", "2022-01-01T00:00:00Z", "x", "Work")]
    assert state(M.converge(facts(spark, again), itself)) == {"x": {"work", "reading"}}


def test_a_record_that_comes_back_has_its_new_keys_only(spark):
    rows = [("A", OLD, "x", "a b"), ("D", MID, "x", ""), ("A", NEW, "x", "c")]
    assert state(M.converge(facts(spark, rows), itself)) == {"x": {"c"}}
    assert [r["keys"] for r in M.replay(facts(spark, rows), itself).collect()] == [["c"]]


def test_links_reach_their_record(spark):
    rows = [("A", OLD, "v1", "k"), ("M", None, "v1", "v2"), ("D", MID, "v2", "")]
    assert state(M.converge(facts(spark, rows), itself)) == {}
    rows[2] = ("D", "2019-01-01T00:00:00Z", "v2", "")
    merged = M.converge(facts(spark, rows), itself)
    assert state(merged) == {"v1": {"k"}} and [(r.rec, r.value) for r in merged.links.collect()] == [("v1", "v2")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_order_and_repetition_converges(spark, seed):
    rnd = random.Random(seed)
    times = [f"20{y}-01-01T00:00:00Z" for y in range(10, 16)]
    rows = [(v := rnd.choice("AAKTD"), rnd.choice(times), rnd.choice("xyz"), rnd.choice(["p", "q"] if v in "KT" else ["p", "p q", ""])) for _ in range(40)]
    want = state(M.converge(facts(spark, rows), itself))
    mixed = rows * 2
    rnd.shuffle(mixed)
    assert state(M.converge(facts(spark, mixed), itself)) == want


def test_no_facts(spark):
    empty = spark.createDataFrame([], FACTS)
    assert state(M.converge(empty, itself)) == {} and M.replay(empty, itself).count() == 0


def test_stream_of_batches_equals_one_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice("AADKT"), f"20{rnd.randint(10, 20)}-01-01T00:00:00Z", rnd.choice("uvwx"), rnd.choice("pq")) for _ in range(60)]
    every = facts(spark, rows)
    src = str(tmp_path / "in")
    out = f"file://{tmp_path}/out"
    for part in range(3):
        every.where(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(every.schema).parquet(src)
        q = streams.converge_stream(stream, out, checkpoint=f"file://{tmp_path}/log")
        q.processAllAvailable()
        q.stop()
    got = sorted((r.rec, r.live, r["keys"] if r.live else "") for r in streams.current(spark, out, itself).collect())
    want = sorted((r.rec, r.live, r["keys"] if r.live else "") for r in streams.rows(M.converge(every, itself)).collect())
    assert got == want


def test_documents_of_one_name(spark):
    rows = [("a", "blobs/n.txt", "one"), ("b", "blobs/n.txt", "one"), ("c", "blobs/n.txt", "two"), ("c", "blobs/m", "x")]
    got = {(r.replica, r.path): r.placed for r in M.place_documents(spark.createDataFrame(rows, "replica string, path string, body string")).collect()}
    assert got["a", "blobs/n.txt"] == got["b", "blobs/n.txt"] == "blobs/n.txt" and got["c", "blobs/m"] == "blobs/m"
    assert got["c", "blobs/n.txt"].startswith("blobs/n~") and got["c", "blobs/n.txt"].endswith(".txt")


def test_streamed_replay_equals_batch_replay(spark):
    from keyloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    a, b = (sorted(map(tuple, catalog.QUERIES[q](spark, sf).collect())) for q in ("stream_replay", "replay_merge"))
    assert a == b
