"""The same operators over streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators.facts import true_times
from ..operators.lattice import LATTICE, joined, partials, reduced
from ..operators.lattice import state as lattice_state
from ..operators.merge import Merged
from ..operators.recall import numbered
from ..schema import LINES
from ..scratch import removed
from ..sources.readers import feed_values, parse_lines
from ..sources.tailing import tail_lines
from .stateful import use_store


def _done(query: StreamingQuery) -> None:
    query.processAllAvailable()
    query.stop()


def versions(path: str) -> Callable[[int], str]:
    """Table versions as folders, one per batch: a batch that runs again overwrites its own."""
    return lambda batch: f"{path}/version={batch:010d}"


def feed(lines: DataFrame, keys: list[str], path: str, line: str = "value", *, checkpoint: str) -> StreamingQuery:
    """T1: values of an arriving stream under fixed keys, as records (id, ts, keys, value, ord) under path: a value names one record, whatever batch it comes in again with.

    Values that were fed are in the stream's state, so a batch looks up its own only. New ids follow those of the batch before, in order of the value; a batch that runs again
    writes the same under its own number.
    """
    at, counted = versions(f"{path}/lines"), versions(f"{path}/counts")
    use_store(lines.sparkSession)
    values = lines.select(feed_values(F.col(line)).alias("value")).where("value IS NOT NULL").dropDuplicates(["value"])

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema("n long").parquet(counted(number - 1)).first()[0] if number else 0
        rows = numbered(batch, ["value"], before).withColumns({"ts": F.lit(""), "keys": F.array(*map(F.lit, keys)), "ord": F.lit(0).cast("long")})
        rows.select("id", "ts", "keys", "value", "ord").write.mode("overwrite").parquet(at(number))
        own = spark.read.schema(LINES).parquet(at(number)).agg((F.count(F.lit(1)) + before).alias("n"))
        own.write.mode("overwrite").parquet(counted(number))

    return values.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def fed(spark: SparkSession, path: str) -> DataFrame:
    """The records that feed has put."""
    return spark.read.schema(LINES).parquet(f"{path}/lines").select(*[c.split()[0] for c in LINES.split(", ")])


#: Runs of one level that are merged into one of the next.
FAN = 8


def converge_stream(facts: DataFrame, path: str, *, checkpoint: str) -> StreamingQuery:
    """T2: facts as they arrive, kept as the lattice that they have merged into.

    A batch is reduced to its own partial maxima and written as a run; FAN runs of one level are merged into a run of the next. So a batch reads its own
    facts and, once in FAN batches, runs of its like: over n batches each fact is read about log(n) / log(FAN) times, however long the history. A run is
    named after its batch, so a batch that runs again overwrites its own; runs that the batch before has merged are removed. A C line counts for the A line after it though a
    batch ends between them, if each replica's facts arrive in their order; all else may arrive in any order, links included: names meet when the state is read.
    """
    clocked, done = versions(f"{path}/clocks"), versions(f"{path}/done")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        removed(spark, *[_run(path, level, i) for level, i in _merged_at(number - 1)], *[x(number - 2) for x in (clocked, done) if number > 1])
        # The last A or C of each replica so far, for the first A of this batch.
        rows_ = batch.withColumn("old", F.lit(False))
        if number:
            rows_ = rows_.unionByName(spark.read.schema(batch.schema).parquet(clocked(number - 1)).withColumn("old", F.lit(True)))
        clocks = rows_.where("verb IN ('A', 'C')").groupBy("replica").agg(F.max_by(F.struct(*batch.columns), "seq").alias("c")).select("c.*")
        clocks.write.mode("overwrite").parquet(clocked(number))
        _written(reduced(partials(true_times(rows_).where("NOT old").drop("old"))), _run(path, 0, number))
        below = _merged_at(number)
        for k in range(0, len(below), FAN):
            level, last = below[k + FAN - 1]
            _written(reduced(spark.read.schema(LATTICE).parquet(*[_run(path, *r) for r in below[k : k + FAN]])), _run(path, level + 1, last // FAN))
        spark.range(1).write.mode("overwrite").parquet(done(number))

    return facts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def _run(path: str, level: int, number: int) -> str:
    return f"{path}/runs/{level:02d}-{number:010d}"


def _written(rows: DataFrame, run: str) -> None:
    """Rows of a record lie together, so that a lookup of names skips most of a file."""
    rows.sortWithinPartitions("hash").write.mode("overwrite").parquet(run)


def _merged_at(number: int) -> list[tuple[int, int]]:
    """The runs (level, number) that batch number merges, FAN after FAN from the lowest level."""
    level, out = 0, []
    while number >= 0 and (number + 1) % FAN == 0:
        out += [(level, number + 1 - FAN + i) for i in range(FAN)]
        level, number = level + 1, number // FAN
    return out


def _live_runs(batches: int) -> list[tuple[int, int]]:
    """The runs that hold all of so many batches: at each level those that don't make up a whole one of the next."""
    level, out = 0, []
    while batches:
        out += [(level, i) for i in range(batches - batches % FAN, batches)]
        level, batches = level + 1, batches // FAN
    return out


def merged_so_far(spark: SparkSession, path: str) -> DataFrame:
    """The lattice that converge_stream has reached."""
    last = spark.read.schema("id long, version int").parquet(f"{path}/done").agg(F.max("version")).first()[0]
    return joined(spark.read.schema(LATTICE).parquet(*[_run(path, *r) for r in _live_runs(last + 1)]))


def rows(state: Merged) -> DataFrame:
    """(rec, value, live, keys) of a merged state."""
    keys = state.keys.groupBy("rec").agg(F.array_join(F.array_sort(F.collect_list("key")), " ").alias("keys"))
    return state.records.join(keys, "rec", "left").select("rec", "value", "live", F.coalesce("keys", F.lit("")).alias("keys"))


def current(spark: SparkSession, path: str, hash_of=content_hash) -> DataFrame:
    """(rec, value, live, keys) that converge_stream has reached."""
    return rows(lattice_state(merged_so_far(spark, path), hash_of))


def liveness(facts: DataFrame) -> DataFrame:
    """Record liveness alone, as a native streaming aggregate in update or complete mode."""
    add, gone = (F.max(F.when(F.col("verb") == v, F.coalesce("ts", F.lit("")))) for v in "AD")
    out = facts.groupBy("hash").agg(add.alias("add_ts"), gone.alias("del_ts"))
    return out.withColumn("live", F.col("add_ts").isNotNull() & F.coalesce(F.col("add_ts") > F.col("del_ts"), F.lit(True)))


def without_replays(facts: DataFrame, at: str, delay: str) -> DataFrame:
    """T5: replays within the watermark go; state is bounded by the delay. What a fact says includes its keys, in any order."""
    told = facts.withColumn("sorted_keys", F.array_sort("keys")).withWatermark(at, delay)
    return told.dropDuplicatesWithinWatermark(["verb", "hash", "key", "ts", "value", "sorted_keys"]).drop("sorted_keys")


def forgetting(facts: DataFrame, at: str, delay: str) -> DataFrame:
    """T6: latest delete per record and day, kept for the delay only; a replica that is older may add its record again."""
    return facts.where("verb = 'D'").withWatermark(at, delay).groupBy(F.window(at, "1 day"), "hash").agg(F.max("ts").alias("del_ts"))


def tail(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """T8: (lines, rejects) of a store that grows by lines or files; ord is a line's place, so that a record's links keep their order."""
    return parse_lines(tail_lines(spark, path))


def per_day(records: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """T7: records per day."""
    return records.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))


def tag_counts(lines: DataFrame) -> DataFrame:
    """T7: live counts of tags, for complete mode."""
    return lines.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def run_once(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Let a stream take all that there is, and read what it gave: executors write each batch under path, the driver holds no rows."""
    at, told = versions(f"{path}/out"), []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(at(number))
        told.append(number)

    _done(stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/log").start())
    # In complete mode each batch is the whole answer.
    paths = [at(i) for i in sorted(set(told))][-1 if mode == "complete" else 0 :]
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*paths) if paths else spark.createDataFrame([], stream.schema)
