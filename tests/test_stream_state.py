"""A converging stream of several batches ends as one merge of all facts does."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import facts as X
from keyloom.operators import merge as M
from keyloom.schema import FACTS
from keyloom.streaming import streams

T1, T2, T3 = "2020-01-01T00:00:00Z", "2021-01-01T00:00:00Z", "2022-01-01T00:00:00Z"


def itself(col):
    return col


def fact(replica, seq, verb, ts, rec, more=""):
    return (replica, seq, verb, ts, rec, more if verb in "KT" else None, more.split() if verb == "A" else None, rec if verb == "A" else more if verb == "M" else None)


CASES = {
    "delete by a further link": [[fact("r", 1, "A", T1, "v1", "k"), fact("r", 2, "M", None, "v1", "v2")], [fact("r", 3, "D", T2, "v2")]],
    "link after the facts it names": [[fact("r", 1, "A", T1, "v1", "k"), fact("r", 2, "D", T2, "v2")], [fact("r", 3, "M", None, "v1", "v2")]],
    "link takes over a record": [[fact("r", 1, "A", T1, "v1", "k"), fact("r", 2, "A", T2, "v2", "l")], [fact("r", 3, "M", None, "v1", "v2")], [fact("r", 4, "K", T3, "v2", "l")]],
    "link moves to a smaller record": [[fact("r", 1, "A", T1, "v5", "k"), fact("r", 2, "M", None, "v5", "v9"), fact("r", 3, "T", T2, "v9", "z")], [fact("s", 1, "A", T1, "v0", "q"), fact("s", 2, "M", None, "v0", "v9")]],
    "clock before a batch's end": [[fact("r", 1, "A", T1, "x", "work"), fact("r", 2, "K", T2, "x", "work"), fact("r", 3, "C", T1, "x")], [fact("r", 4, "A", T3, "x", "work")]],
    "equal times, other keys": [[fact("r", 1, "A", T1, "x", "a")], [fact("s", 1, "A", T1, "x", "b")], [fact("r", 2, "A", T1, "x", "a")]],
    "a batch of nothing new": [[fact("r", 1, "A", T1, "x", "a")], [fact("r", 1, "A", T1, "x", "a")]],
}


def plain(rows):
    return sorted((r.rec, r.value, r.live, r["keys"] if r.live else "") for r in rows.collect())


@pytest.mark.parametrize("fan", [8, 2])
@pytest.mark.parametrize("name", CASES)
def test_stream_ends_as_the_merge(spark, tmp_path, monkeypatch, name, fan):
    monkeypatch.setattr(streams, "FAN", fan)
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for rows in CASES[name]:
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(src)
        q = streams.converge_stream(spark.readStream.schema(FACTS).parquet(src), out, checkpoint=f"file://{tmp_path}/log")
        q.processAllAvailable()
        q.stop()
    every = spark.createDataFrame([r for rows in CASES[name] for r in rows], FACTS)
    assert plain(streams.current(spark, out, itself)) == plain(streams.rows(M.converge(every, itself)))


def test_facts_that_say_other_keys_are_not_replays(spark):
    rows = [fact("r", 1, "A", T1, "x", "a"), fact("s", 1, "A", T1, "x", "b"), fact("s", 2, "A", T1, "x", "b a"), fact("t", 1, "A", T1, "x", "a b")]
    frame = spark.createDataFrame(rows, FACTS)
    one = X.distinct_facts(frame)
    assert sorted(sorted(r["keys"]) for r in one.collect()) == [["a"], ["a", "b"], ["b"]]
    assert {r.key for r in M.converge(one, itself).keys.collect()} == {"a", "b"}


def test_true_times_come_before_dedupe(spark):
    """A C line stands before each replica's own A line; both A lines keep the time it tells."""
    rows = [fact(r, s, v, ts, "x", k) for r in "rs" for s, v, ts, k in ((1, "C", T1, ""), (2, "A", T3, "work"))] + [fact("t", 1, "K", T2, "x", "work")]
    timed = X.distinct_facts(X.true_times(spark.createDataFrame(rows, FACTS)))
    assert [r.true_ts for r in timed.where("verb = 'A'").collect()] == [T1]
    assert M.converge(timed, itself).keys.count() == 0


def test_replayed_keys_against_a_plain_fold(spark):
    from keyloom.plans import catalog, tables

    sf = "/root/testdata/sf0.001"
    got = {r.rec: (r.live, r.ts, r["keys"]) for r in catalog.QUERIES["replay_merge"](spark, sf).collect()}
    facts = tables.event_facts(spark, sf).orderBy("replica", "seq").collect()
    state = {}
    for f in facts:
        s = state.setdefault(f.hash, {"seen": False, "live": False, "ts": "", "gone": "", "on": {}, "off": {}})
        if f.verb == "A":
            if s["seen"] and not s["live"]:
                if f.ts <= s["gone"]:
                    continue
                s["on"], s["off"] = {}, {}
            s.update(seen=True, live=True, ts=max(s["ts"], f.ts))
            for k in f["keys"]:
                if f.ts > s["off"].get(k, ""):
                    s["off"].pop(k, None)
                    s["on"][k] = max(s["on"].get(k, ""), f.ts)
        elif f.verb == "D":
            if s["seen"] and f.ts >= s["ts"]:
                s.update(live=False, gone=max(s["gone"], f.ts))
        elif s["live"]:
            mine, other = (s["off"], s["on"]) if f.verb == "K" else (s["on"], s["off"])
            if f.ts > other.get(f.key, "") or (f.verb == "K" and f.ts == other.get(f.key, "")) or f.key not in other:
                mine[f.key] = max(mine.get(f.key, ""), f.ts)
                other.pop(f.key, None)
    want = {h: (s["live"], s["ts"], " ".join(sorted(s["on"])) if s["live"] else "") for h, s in state.items() if s["seen"]}
    assert got == want


def test_zipf_index_has_the_stated_shape(spark):
    from keyloom.operators import generate

    n = 20_000
    rows = generate.zipf_index(spark.range(1, n + 1).toDF("n"), "n", words=400).cache()
    two = rows.where(F.size("keys") == 2).count() / n
    assert rows.count() == n and 0.70 < two < 0.81  # of the second draws some repeat the first
    counts = {r["key"]: r["count"] for r in rows.select(F.explode("keys").alias("key")).groupBy("key").count().collect()}
    weights = [1 / k**1.1 for k in range(1, 401)]
    # The hottest words follow the weights, less what repeats inside a record.
    for k in (0, 1, 2, 10):
        share = weights[k] / sum(weights)
        want = n * (0.2 * share + 0.8 * (1 - (1 - share) ** 2))
        assert abs(counts[f"w{k}"] - want) < 0.1 * want
    times = [r.ts for r in rows.orderBy("id").select("ts").collect()]
    assert times == sorted(times)
    again = generate.zipf_index(spark.range(1, n + 1).toDF("n").repartition(7), "n", words=400)
    assert again.exceptAll(rows).isEmpty()
