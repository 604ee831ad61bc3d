"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh, removed
from ..spread import spread_join

__all__ = ["ascii_lower", "documents", "dropped", "let", "marked", "maybe_in", "saved", "spread_join", "unused", "word_count"]

#: A word of the contracts: a longest run without blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Folders of saved tables.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again.

    A lost executor costs at most the tasks it was running; what is written stays.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete saved tables; all that was to be made of them must be stored by then."""
    for table in tables:
        removed(table.sparkSession, _PATHS.pop(table))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind value to a name, so that it is evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _bits(keys: DataFrame, own: Column, bits: int) -> DataFrame:
    """(word_, bits_): the map of as many bits of keys' own, in words of 64."""
    place = F.pmod(own, F.lit(bits))
    return keys.select(place.alias("place_")).groupBy(F.shiftright("place_", 6).alias("word_")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place_ & 63 as int))")).alias("bits_"))


def marked(rows: DataFrame, key: Column, keys: DataFrame, own: Column, bits: int, name: str) -> DataFrame:
    """Rows with a column name: whether their key may be among keys' own. It is never false where it is; rows stay where they are.

    keys, numbers of 64 bits, go to all tasks as a map of as many bits, in words of 64 and so with a row per word at most. A full map marks all rows.
    """
    near = rows.withColumn("place_", F.pmod(key, F.lit(bits))).withColumn("word_", F.shiftright("place_", 6)).join(F.broadcast(_bits(keys, own, bits)), "word_", "left")
    met = F.expr("shiftrightunsigned(coalesce(bits_, 0L), cast(place_ & 63 as int)) & 1") == 1
    return near.select(*rows.columns, met.alias(name))


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame, own: Column, bits: int) -> DataFrame:
    """Rows whose key is among keys' own, and a few others; rows stay where they are.

    keys, numbers of 64 bits, go to all tasks as a map of as many bits, in words of 64 and so with a row per word at most. A full map lets
    all rows pass, which costs what a join without it would.
    """
    near = rows.withColumn("place_", F.pmod(key, F.lit(bits))).withColumn("word_", F.shiftright("place_", 6)).join(F.broadcast(_bits(keys, own, bits)), "word_")
    return near.where(F.expr("shiftrightunsigned(bits_, cast(place_ & 63 as int)) & 1") == 1).select(*rows.columns)


def unused(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no column of frames is called so."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
