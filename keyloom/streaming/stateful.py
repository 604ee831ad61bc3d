"""Operators whose state is a record's own, on transformWithState: a batch reads and writes the state of the keys that it touches only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import content_hash, key_encode
from ..schema import FACTS

#: State of many keys and timers needs a store on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TIMED = FACTS + ", name string, true_ts string"


def use_store(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class _Clocks(StatefulProcessor):
    """A replica's A lines with the true time that a C line just before them tells; the last A or C is kept for the next batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "verb string, ts string, hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = []
        for frame in rows:
            other = frame[~frame["verb"].isin(["A", "C"])]
            yield other.assign(true_ts=None)
            held.append(frame[frame["verb"].isin(["A", "C"])])
        clocks = pd.concat(held).sort_values("seq", kind="stable")
        if len(clocks):
            before = clocks[["verb", "ts", "hash"]].shift(1)
            if self.last.exists():
                before.iloc[0] = list(self.last.get())
            paired = (clocks["verb"] == "A") & (before["verb"] == "C") & (before["hash"] == clocks["hash"])
            out = clocks.assign(true_ts=before["ts"].where(paired, clocks["ts"]))
            self.last.update(tuple(clocks.iloc[-1][["verb", "ts", "hash"]]))
            yield out[out["verb"] == "A"]


class _Links(StatefulProcessor):
    """The record that a name stands for: the smallest of those that M facts so far have told it is a further link of, else itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "head string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        heads = [h for f in frames for h in f.loc[f["verb"] == "M", "hash"].dropna()]
        known = self.head.get()[0] if self.head.exists() else None
        head = min([*heads, *([known] if known is not None else [])], default=None)
        if head != known:
            self.head.update((head,))
        for f in frames:
            yield f[f["verb"] != "M"].drop(columns="name").assign(rec=head if head is not None else key[0])


class _Record(StatefulProcessor):
    """A record's latest stamp, and the latest stamp of each key since the record last came back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "top string, gone boolean, ts string")
        self.keys = handle.getMapState("keys", "key string", "ts string, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, gone, ts = self.record.get() if self.record.exists() else (None, False, "")
        fresh, touched = False, {}

        def stamp(name: str, at: str, off: bool) -> None:
            if name not in touched:
                touched[name] = None if fresh else self.keys.getValue((name,))
            if touched[name] is None or (at, off) > tuple(touched[name]):
                touched[name] = (at, off)

        every = pd.concat(rows).sort_values(["replica", "seq"], kind="stable")
        for row in every[["verb", "ts", "true_ts", "key", "keys"]].itertuples(index=False):
            if row.verb == "A" and (top is None or not gone or row.ts > top):
                if top is None or gone:
                    fresh, touched = True, {}
                if top is None or row.ts > top:
                    top = ts = row.ts
                gone = False
                for name in row.keys if row.keys is not None else []:
                    stamp(name, row.true_ts or row.ts, False)
            elif row.verb == "D" and top is not None:
                gone, top = gone or row.ts >= top, max(top, row.ts)
            elif row.verb in ("K", "T") and top is not None and not gone and row.key is not None:
                stamp(row.key, row.ts, row.verb == "K")
        if top is None:
            return
        if fresh:
            self.keys.clear()
        for name, value in touched.items():
            if value is not None:
                self.keys.updateValue((name,), value)
        self.record.update((top, gone, ts))
        shown = [] if gone else sorted(k[0] for k, v in self.keys.iterator() if not v[1])
        yield pd.DataFrame({"rec": [key[0]], "live": [not gone], "ts": [ts], "keys": [shown]})


def replay_stream(facts: DataFrame, hash_of=content_hash) -> DataFrame:
    """T3: (rec, live, ts, keys) of the records that a batch touches, after its facts in order of replica and sequence; append mode.

    Three stages, each with the state of its own keys: a replica's last clock, a name's record, a record's stamps. Batches that arrive in stream order end as replay does, but for
    links told after facts of their name were applied: these facts stay where they went. A stage holds what one batch brings its key, which the size of a batch bounds; what earlier
    batches brought is a stamp a key. Rows with null names or times are taken as empty ones.
    """
    use_store(facts.sparkSession)
    name = F.when(F.col("verb") == "M", hash_of(F.col("value"))).otherwise(F.col("hash"))
    coded = facts.withColumns({
        "key": key_encode(F.col("key")), "keys": F.transform("keys", key_encode), "ts": F.coalesce("ts", F.lit("")), "name": F.coalesce(name, F.lit("")),
        "replica": F.coalesce("replica", F.lit("")),
    }).select(*[c.split()[0] for c in FACTS.split(", ")], "name")
    # Only lines that a clock is told by or for pass the stage of few keys, the replicas.
    clocked = F.col("verb").isin("A", "C")
    timed = coded.where(clocked).groupBy("replica").transformWithStateInPandas(_Clocks(), _TIMED, "append", "none")
    timed = timed.unionByName(coded.where(~F.coalesce(clocked, F.lit(False))).withColumn("true_ts", F.lit(None).cast("string")))
    named = timed.groupBy("name").transformWithStateInPandas(_Links(), _TIMED.replace(", name string", "") + ", rec string", "append", "none")
    return named.groupBy("rec").transformWithStateInPandas(_Record(), "rec string, live boolean, ts string, keys array<string>", "append", "none")


class _Forgetting(StatefulProcessor):
    """A record's latest delete until the watermark is delay past it."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.delete = handle.getValueState("delete", "ts string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ts, until = self.delete.get() if self.delete.exists() else (None, 0)
        was, out = until, []
        for row in pd.concat(rows).sort_values(["at_ms", "seq"], kind="stable").itertuples(index=False):
            if row.verb == "D":
                ts, until = max(ts or "", row.ts), max(until, row.at_ms + self.delay_ms)
                out.append((key[0], row.seq, "deleted"))
            else:
                out.append((key[0], row.seq, "added" if ts is None or row.ts > ts else "refused"))
        if until > was:
            self.delete.update((ts, until))
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["hash", "seq", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.delete.exists() and self.delete.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.delete.clear()
        return iter(())


def forgetting_stream(facts: DataFrame, at: str, delay: str, kept_ms: int) -> DataFrame:
    """T6: (hash, seq, status) of A and D facts (hash, seq, verb, ts, at): added, refused or deleted; append mode.

    A delete refuses additions that are not later than it, until the watermark, which is delay behind the latest event time, has passed it by kept_ms; from then on a replica that
    is older lets the record return. Facts of a batch are taken in order of event time and sequence.
    """
    use_store(facts.sparkSession)
    rows = facts.where("verb IN ('A', 'D') AND hash IS NOT NULL").withWatermark(at, delay)
    rows = rows.select("hash", "seq", "verb", F.coalesce("ts", F.lit("")).alias("ts"), F.col(at), F.unix_millis(at).alias("at_ms"))
    return rows.groupBy("hash").transformWithStateInPandas(_Forgetting(kept_ms), "hash string, seq long, status string", "append", "eventtime")
