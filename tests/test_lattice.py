"""Merged states that facts can be told from again, and streams and replays over parts."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from keyloom.functions.text import content_hash
from keyloom.operators import facts as X
from keyloom.operators import lattice as L
from keyloom.operators import merge as M
from keyloom.schema import FACTS
from keyloom.sources import readers as S
from keyloom.streaming import streams

from .plain_replay import Replayed

TIMES = [f"20{y}-01-01T00:00:00Z" for y in range(10, 18)]


def values(spark, names):
    """Content hash of each name."""
    return {r.n: r.h for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", content_hash(F.col("n")).alias("h")).collect()}


def some_facts(rng, hashes, replica, n, links=True):
    """A replica's stream: additions with and without true times, deletes, attachments, detachments, links."""
    out = []
    for seq in range(0, 2 * n, 2):
        verb, name, ts = rng.choice("AAADKKTTM" if links else "AAADKKTT"), rng.choice(sorted(hashes)), rng.choice(TIMES)
        key, keys = rng.choice(["p", "q", "Rr"]), rng.choice([[], ["p"], ["p", "q"], ["q", "Rr"]])
        h = hashes[name]
        if verb == "A":
            if rng.random() < 0.4:
                out.append((replica, seq, "C", rng.choice(TIMES), h, None, None, None))
            out.append((replica, seq + 1, "A", ts, h, None, keys, name))
        elif verb == "M":
            out.append((replica, seq, "M", None, h, None, None, rng.choice(sorted(hashes))))
        else:
            out.append((replica, seq, verb, ts, h, key if verb in "KT" else None, None, None))
    return out


def plain(merged):
    keys = {}
    for r in merged.keys.collect():
        keys.setdefault(r.rec, []).append(r.key)
    live = {r.rec: sorted(keys.get(r.rec, [])) for r in merged.records.where("live").collect()}
    return live, sorted((r.rec, r.value) for r in merged.links.collect())


def reread(spark, rows, replica, tmp_path):
    """The lines of a lattice, written in their order and parsed as another replica's facts."""
    path = str(tmp_path / f"told-{replica}")
    L.told_lines(rows).orderBy("section", "id", "place").select("line").coalesce(1).write.text(path)
    lines = S.read_text(spark, path).select("line", F.col("ord").alias("seq"), F.lit(replica).alias("replica"))
    facts = S.parse_facts(lines, "").where("status = 'fact'")
    hashed = F.when(F.col("verb") == "A", content_hash(F.col("value"))).otherwise(F.col("hash"))
    return facts.select("replica", "seq", "verb", "ts", hashed.alias("hash"), "key", "keys", "value")


@pytest.mark.parametrize("seed", range(2))
def test_an_export_tells_all_that_its_device_knows(spark, tmp_path, seed):
    """Three replicas: whoever hears of two through the third's export ends where all facts end, whatever came before and comes after."""
    rng = random.Random(seed)
    hashes = values(spark, ["v1", "v2", "v3", "v4"])
    a, b, c = (spark.createDataFrame(some_facts(rng, hashes, r, 25), FACTS).cache() for r in "abc")
    want = plain(M.converge(a.unionByName(b).unionByName(c)))
    ab = L.joined(L.lattice(a), L.lattice(b))
    assert plain(L.state(ab)) == plain(M.converge(a.unionByName(b)))
    told = reread(spark, ab, "ab", tmp_path).cache()
    assert plain(M.converge(told)) == plain(M.converge(a.unionByName(b)))
    assert plain(M.converge(told.unionByName(c))) == want
    back = reread(spark, L.joined(L.lattice(told), L.lattice(c)), "abc", tmp_path).cache()
    assert plain(M.converge(back)) == want and plain(M.converge(back.unionByName(a))) == want


@pytest.mark.parametrize("seed", range(1))
def test_lattices_merge_in_any_grouping(spark, seed):
    rng = random.Random(100 + seed)
    hashes = values(spark, ["x", "y", "z"])
    parts = [L.lattice(spark.createDataFrame(some_facts(rng, hashes, r, 20), FACTS)).cache() for r in "abc"]
    rows = lambda df: sorted(map(str, df.select(*L.LATTICE.replace(" string", "").split(", ")).collect()))
    a, b, c = parts
    assert rows(L.joined(a, b, c)) == rows(L.joined(L.joined(c, a), b)) == rows(L.joined(a, L.joined(b, c), c))
    assert rows(L.reduced(a)) == rows(a)


def test_a_detached_key_stays_detached_after_an_export(spark, tmp_path):
    """Replica 2 still holds the line with the key; hearing of replica 1's export only, it must lose it."""
    h = values(spark, ["doc"])["doc"]
    one = [("1", 0, "A", TIMES[0], h, None, ["a", "b"], "doc"), ("1", 1, "K", TIMES[2], h, "a", None, None)]
    two = [("2", 0, "A", TIMES[0], h, None, ["a", "b"], "doc")]
    told = reread(spark, L.lattice(spark.createDataFrame(one, FACTS)), "x", tmp_path)
    assert {(r.verb, r.key) for r in told.where("verb <> 'A'").collect()} == {("K", "a")}
    merged = M.converge(told.unionByName(spark.createDataFrame(two, FACTS)))
    assert plain(merged)[0] == {h: ["b"]}


def test_keys_carried_past_a_delete_keep_their_true_time(spark, tmp_path):
    h = values(spark, ["doc"])["doc"]
    rows = [("1", 0, "C", TIMES[0], h, None, None, None), ("1", 1, "A", TIMES[5], h, None, ["a"], "doc"), ("1", 2, "D", TIMES[3], h, None, None, None), ("1", 3, "A", TIMES[4], h, None, ["b"], "doc")]
    lattice = L.lattice(spark.createDataFrame(rows, FACTS))
    told = reread(spark, lattice, "x", tmp_path)
    assert [(r.verb, r.ts) for r in told.orderBy("seq").collect()] == [("A", TIMES[5]), ("C", TIMES[0]), ("A", TIMES[5]), ("D", TIMES[3]), ("T", TIMES[4])]
    late = spark.createDataFrame([("2", 0, "K", TIMES[1], h, "a", None, None)], FACTS)
    assert plain(M.converge(told.unionByName(late)))[0] == {h: ["b"]} == plain(M.converge(spark.createDataFrame(rows, FACTS).unionByName(late)))[0]


def test_nothing_known(spark):
    empty = L.lattice(spark.createDataFrame([], FACTS))
    assert L.told_lines(empty).count() == 0 and plain(L.state(empty)) == ({}, [])


def stream(spark, tmp_path, batches, fan, monkeypatch, before=lambda n: None):
    monkeypatch.setattr(streams, "FAN", fan)
    src, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, FACTS).coalesce(1).write.mode("append").parquet(src)
        before(n)
        q = streams.converge_stream(spark.readStream.schema(FACTS).parquet(src), out, checkpoint=f"file://{tmp_path}/log")
        q.processAllAvailable()
        q.stop()
    return out


def test_a_long_stream_ends_as_one_merge(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    hashes = values(spark, ["x", "y", "z"])
    batches = []
    for n in range(11):
        batches.append([(r, seq + 100 * n, *rest) for r, seq, *rest in some_facts(rng, hashes, f"r{n % 3}", 6)])
    out = stream(spark, tmp_path, batches, 3, monkeypatch)
    every = spark.createDataFrame([r for rows in batches for r in rows], FACTS)
    assert plain(L.state(streams.merged_so_far(spark, out))) == plain(M.converge(every))
    # 11 batches are a run of nine and two single ones; all others were merged and are gone.
    assert sorted(d[:2] for d in os.listdir(tmp_path / "out" / "runs")) == ["00", "00", "02"]


def test_a_batch_reads_no_older_run_unless_it_merges(spark, tmp_path, monkeypatch):
    """The first runs are out of reach while later batches run."""
    hashes = values(spark, ["x"])
    rng = random.Random(3)
    batches = [some_facts(rng, hashes, f"r{n}", 3) for n in range(5)]
    runs, aside = tmp_path / "out" / "runs", tmp_path / "aside"

    def hide(n):
        if n == 2:
            shutil.move(runs, aside)

    out = stream(spark, tmp_path, batches, 8, monkeypatch, hide)
    for d in os.listdir(aside):
        shutil.move(aside / d, runs / d)
    every = spark.createDataFrame([r for rows in batches for r in rows], FACTS)
    assert plain(L.state(streams.merged_so_far(spark, out))) == plain(M.converge(every))


def test_runs_of_a_binary_counter(monkeypatch):
    monkeypatch.setattr(streams, "FAN", 3)
    have = set()
    for n in range(60):
        have.add((0, n))
        merged = streams._merged_at(n)
        for k in range(0, len(merged), 3):
            assert set(merged[k : k + 3]) <= have
            have -= set(merged[k : k + 3])
            have.add((merged[k][0] + 1, merged[k + 2][1] // 3))
        assert have == set(streams._live_runs(n + 1))


def fold(rows):
    """One record's facts, one by one."""
    record = Replayed()
    for _, _, verb, ts, true_ts, key, keys in sorted(rows, key=lambda r: r[:2]):
        record.take(verb, ts, true_ts, key, keys)
    return record


@pytest.mark.parametrize(("seed", "run"), [(0, 4096), (1, 3), (2, 2), (3, 1)])
def test_replay_in_runs_equals_a_plain_fold(spark, monkeypatch, seed, run):
    """Few times, so that ties are common; one record has most of the facts."""
    monkeypatch.setattr(M, "RUN", run)
    monkeypatch.setattr(X, "RUN", run)
    rng = random.Random(seed)
    rows = []
    for seq in range(400):
        rec, verb = rng.choice(["hot"] * 6 + [f"r{i}" for i in range(30)]), rng.choice("AADDKKTTC")
        key = rng.choice("pqr")
        rows.append((rng.choice("ab"), seq, verb, rng.choice([*TIMES, None]), rec, key if verb in "KT" and rng.random() < 0.95 else None, rng.choice([[], ["p"], ["p", "q"], None]) if verb == "A" else None, rec if verb == "A" else None))
    facts = spark.createDataFrame(rows, FACTS)
    by = {}
    for r in X.true_times(facts).collect():
        by.setdefault(r.hash, []).append((r.replica, r.seq, r.verb, r.ts or "", r.true_ts, r.key, r["keys"]))
    want = sorted(f.row(rec) for rec, rows in by.items() if (f := fold(rows)).seen)
    got = sorted((r.rec, r.live, r.ts, r["keys"]) for r in M.replay(facts, lambda c: c).collect())
    assert got == want and len(got) > 20


def test_replay_of_a_busy_record_is_spread(spark):
    """A third of all facts are one record's; no task folds them all."""
    n = 30_000
    rec = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), (F.col("id") % 5000).cast("string")))
    verb = F.element_at(F.array(*map(F.lit, "ADKTAT")), (F.col("id") % 6 + 1).cast("int"))
    day = F.date_format(F.timestamp_seconds(1_500_000_000 + F.pmod(F.xxhash64("id"), F.lit(1_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    facts = spark.range(n).select(
        (F.col("id") % 4).cast("string").alias("replica"), F.col("id").alias("seq"), verb.alias("verb"), day.alias("ts"), rec.alias("hash"),
        F.when(verb.isin("K", "T"), "k").alias("key"), F.when(verb == "A", F.array(F.lit("k"))).alias("keys"), F.when(verb == "A", rec).alias("value"),
    )
    out = M.replay(facts, lambda c: c)
    assert "MapInPandas" not in out._jdf.queryExecution().toString()
    rows = [(r.replica, r.seq, r.verb, r.ts, r.true_ts, r.key, r["keys"]) for r in X.true_times(facts.where("hash = 'hot'")).collect()]
    got = out.where("rec = 'hot'").collect()
    assert [(r.rec, r.live, r.ts, r["keys"]) for r in got] == [fold(rows).row("hot")]
