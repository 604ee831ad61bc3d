"""Writers: dumps, exports, compacted stores, postings, trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views
from ..operators.facts import as_text, export
from ..schema import State
from ..scratch import saved


def dump_line(keys: Column, value: Column) -> Column:
    """KEY... -v VALUE; a keyless record is -v VALUE."""
    return F.concat(F.when(F.size(keys) > 0, F.concat(F.array_join(keys, " "), F.lit(" "))).otherwise(""), F.lit("-v "), value)


def dump(state: State) -> DataFrame:
    """(id, ord, line) of live links."""
    shown = views.shown(state.lines, state.tomb, state.ktomb)
    return shown.select("id", "ord", dump_line(F.col("keys"), F.col("value")).alias("line"))


def write_dump(state: State, path: str) -> None:
    saved(dump(state), "dump").orderBy("id", "ord").select("line").write.text(path)


def write_export(state: State, path: str) -> None:
    # An order over all rows reads them twice, for its ranges and for the rows.
    saved(as_text(export(state)), "export").orderBy("section", "id", "place", "line").select("line").write.text(path)


def store_line(row_ts: Column, keys: Column, value: Column, id: Column) -> Column:
    """id|ts|keys|value; a record without a time is id|keys|value, as an empty second field would be read as no keys."""
    return F.concat_ws("|", id.cast("string"), F.when(row_ts != "", row_ts), F.array_join(keys, " "), value)


def write_store(lines: DataFrame, path: str) -> None:
    """A store as text, ascending by id."""
    lines.orderBy("id", "ord").select(store_line(F.col("ts"), F.col("keys"), F.col("value"), F.col("id"))).write.text(path)


def write_postings(postings: DataFrame, path: str) -> None:
    """Postings sorted by key and id over all files, so that a recall reads its keys' row groups only and a hot key spreads over several files."""
    postings.repartitionByRange("key", "id").sortWithinPartitions("key", "id").write.parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, id long").parquet(path)


def sanitised(trials: DataFrame, free_text: str = "answer") -> DataFrame:
    return trials.drop(free_text)
