"""A stored index: the derived tables of a state, written once in the order that recalls and browsing read them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_encode
from ..schema import LINES, State
from ..scratch import removed, saved
from . import views
from .recall import page


class Index(NamedTuple):
    """links: live links (id, ts, keys, ekeys, value, ord, place, extra) by id, place 1 being the record itself; words (key, word, bits) by key: the ids 64 * word + i of a key's
    records as bits i of a number; counts (key, n); hidden (key): keys that only dead records or detachments have; deleted (id): records with a tombstone.
    """

    links: DataFrame
    words: DataFrame
    counts: DataFrame
    hidden: DataFrame
    deleted: DataFrame

    @property
    def records(self) -> DataFrame:
        """First links; the filter reaches the scan."""
        return self.links.where("place = 1")

    @property
    def postings(self) -> DataFrame:
        """(key, id); a filter on the key reaches the scan."""
        return ids_of(self.words, "key")


_LINKS = "id long, ts string, keys array<string>, ekeys array<string>, value string, ord long, place int, extra long"
_SHOWN = LINES + ", ekeys array<string>"
_SCHEMAS = Index(_LINKS, "key string, word long, bits long", "key string, n long", "key string", "id long")


def ids_of(words: DataFrame, *keep: str) -> DataFrame:
    """The ids that bits stand for, beside the columns keep."""
    at = F.explode(F.expr("filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1) = 1)"))
    return words.select(*keep, "word", at.alias("at")).select(*keep, (F.col("word") * 64 + F.col("at")).alias("id"))


def words_of(postings: DataFrame, *by: str) -> DataFrame:
    """(by, word, bits) of (by, id): partial bits before the shuffle, which carries a row for 64 ids of a busy key."""
    bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
    return postings.groupBy(*by, F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _counted(words: DataFrame) -> DataFrame:
    return words.groupBy("key").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def _placed(shown: DataFrame) -> DataFrame:
    place, n = F.row_number().over(views.by_id()), F.count(F.lit(1)).over(views.by_id().rowsBetween(-(1 << 63), (1 << 63) - 1))
    return shown.select("id", "ts", "keys", "ekeys", "value", "ord", place.alias("place"), (n - 1).alias("extra"))


def _hidden(state: State) -> DataFrame:
    """Keys of the records that a tombstone or a detachment names; all others show what they have."""
    named = state.tomb.select("id").unionByName(state.ktomb.select("id")).distinct()
    firsts = state.lines.join(named, "id", "left_semi").groupBy("id").agg(F.min_by("keys", F.struct("ord", "value")).alias("keys"))
    return firsts.select(F.explode(F.transform("keys", key_encode)).alias("key")).distinct()


def write_index(state: State, path: str) -> Index:
    """Write the index of a state under path. Links are ranged by id before their place in the record is counted, which keeps that order."""
    spark = state.lines.sparkSession
    # What is ranged is read twice, for its bounds and for its rows.
    views.shown(state.lines, state.tomb, state.ktomb).write.parquet(f"{path}/shown")
    shown = spark.read.schema(_SHOWN).parquet(f"{path}/shown")
    _placed(shown.repartitionByRange("id")).write.parquet(f"{path}/links")
    removed(spark, f"{path}/shown")
    stored = spark.read.schema(_LINKS).parquet(f"{path}/links")
    words = words_of(stored.where("place = 1").select(F.explode("ekeys").alias("key"), "id"), "key")
    words.repartitionByRange("key", "word").sortWithinPartitions("key", "word").write.parquet(f"{path}/words")
    _counted(spark.read.schema(_SCHEMAS.words).parquet(f"{path}/words")).write.parquet(f"{path}/counts")
    _hidden(state).write.parquet(f"{path}/hidden")
    state.tomb.select("id").distinct().write.parquet(f"{path}/deleted")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in _SCHEMAS._asdict().items()))


def changed(index: Index, part: State, ids: DataFrame) -> Index:
    """The index after the records named by ids have become what part, the state of these records alone, says; others stay as they are.

    Nothing is rebuilt: an overlay of the changed records is joined when the index is read. Their links replace the old ones, their bits are taken out of the stored words and the new ones put in,
    and counts change by the difference. New records are ids that the index has not; put, untag and delete are the same to it. `rewritten` makes a stored index of it.
    """
    own = saved(ids.select("id").distinct(), "index-changed")
    links = saved(_placed(views.shown(part.lines, part.tomb, part.ktomb)), "index-overlay")
    new = links.where("place = 1").select(F.explode("ekeys").alias("key"), "id")
    old = index.records.join(own, "id", "left_semi").select(F.explode("ekeys").alias("key"), "id")
    masks = words_of(own).withColumnRenamed("bits", "mask")
    left = index.words.join(masks, "word", "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0).cast("long")))))
    words = left.where("bits <> 0").select("key", "word", "bits").unionByName(words_of(new, "key")).groupBy("key", "word").agg(F.bit_or("bits").alias("bits"))
    step = new.select("key", F.lit(1).cast("long").alias("n")).unionByName(old.select("key", F.lit(-1).cast("long").alias("n")))
    step = step.groupBy("key").agg(F.sum("n").alias("n"))
    counts = index.counts.unionByName(step).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")
    deleted = index.deleted.join(own, "id", "left_anti").unionByName(part.tomb.select("id").distinct())
    # Keys that a record has lost may be the last of their kind, so they count as hidden as long as a line has them.
    hidden = index.hidden.unionByName(_hidden(part)).distinct()
    return Index(index.links.join(own, "id", "left_anti").unionByName(links), words, counts, hidden, deleted)


def rewritten(index: Index, path: str) -> Index:
    """An index with its overlays, stored as one."""
    spark = index.links.sparkSession
    index.links.repartitionByRange("id").sortWithinPartitions("id", "place").write.parquet(f"{path}/links")
    index.words.repartitionByRange("key", "word").sortWithinPartitions("key", "word").write.parquet(f"{path}/words")
    for name in ("counts", "hidden", "deleted"):
        getattr(index, name).write.parquet(f"{path}/{name}")
    return read_index(spark, path)


def stats(index: Index) -> DataFrame:
    """records, keys (those of dead records too) and deleted, in one row, from what the index counted."""
    records = index.records.agg(F.count(F.lit(1)).alias("records"))
    keys = index.counts.select("key").unionByName(index.hidden).distinct().agg(F.count(F.lit(1)).alias("keys"))
    return records.crossJoin(keys).crossJoin(index.deleted.agg(F.count(F.lit(1)).alias("deleted")))  # one row each


def lookup(index: Index, keys: list[str], mode: str = "all", after: int | None = None, limit: int | None = None, most: int | None = None, without: list[str] | None = None) -> DataFrame:
    """Ids filed under all (or any) of keys and none of without: the scan reads the row groups of these keys, and words of 64 ids meet in one aggregation of
    bitwise and, or and not; ids are told from what is left.
    """
    asked, never = ([key_encode(F.lit(k)) for k in names] for names in (keys[:most], without or []))
    if not asked:
        return ids_of(index.words.where(F.lit(False)))
    mine = F.col("key").isin(asked)
    hits = index.words.where(mine | F.col("key").isin(never) if never else mine)
    if after is not None:
        hits = hits.where(F.col("word") >= after >> 6)
    fold = F.bit_or if mode == "any" else F.bit_and
    need = F.lit(1) if mode == "any" else F.size(F.array_distinct(F.array(*asked)))
    sums = hits.groupBy("word").agg(fold(F.when(mine, F.col("bits"))).alias("bits"), F.count_if(mine).alias("n"), F.bit_or(F.when(~mine, F.col("bits"))).alias("never"))
    left = sums.where(F.col("n") >= need).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("never", F.lit(0).cast("long")))))
    return page(ids_of(left), after, limit)


def all_words(index: Index, queries: DataFrame) -> DataFrame:
    """(asked, word, bits): the records under all keys of each distinct set of encoded keys that queries (qid, keys) ask for; asked is what asked_keys gives.

    A set starts from its rarest key's words; those of its other keys are met word by word. So what is read grows with the
    rarest key's postings, 64 ids are a row, and sets that many queries ask for are answered once.
    """
    sets = queries.select(asked_keys(F.col("keys")).alias("asked")).where(F.size("asked") > 0).distinct()
    busy = sets.select("asked", F.explode("asked").alias("key")).join(index.counts, "key")
    rare = busy.groupBy("asked").agg(F.min(F.struct("n", "key")).alias("r"), F.count(F.lit(1)).alias("found")).where("found = size(asked)")
    start = rare.select("asked", F.col("r.key").alias("key")).join(index.words, "key")
    others = start.select("asked", "word", F.explode(F.array_except("asked", F.array("key"))).alias("key")).join(index.words, ["key", "word"])
    met = start.unionByName(others).groupBy("asked", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    return met.where("n = size(asked) AND bits <> 0").select("asked", "word", "bits")


def any_words(index: Index, queries: DataFrame) -> DataFrame:
    """(asked, word, bits): the records under any key of each set, as all_words; ids are never told one by one."""
    sets = queries.select(asked_keys(F.col("keys")).alias("asked")).distinct()
    return sets.select("asked", F.explode("asked").alias("key")).join(index.words, "key").groupBy("asked", "word").agg(F.bit_or("bits").alias("bits"))


def lookup_sets(index: Index, queries: DataFrame) -> DataFrame:
    """(asked, id) for each distinct set of encoded keys that queries ask for all of."""
    return ids_of(all_words(index, queries), "asked")


def asked_keys(keys):
    """The encoded keys that a query asks for, in order."""
    return F.array_sort(F.array_distinct(F.transform(keys, key_encode)))


def lookup_batch(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, id) of queries (qid, keys) that ask for all of their keys."""
    return queries.select("qid", asked_keys(F.col("keys")).alias("asked")).join(lookup_sets(index, queries), "asked").select("qid", "id")


def tagged(index: Index, ids: DataFrame) -> DataFrame:
    """(id, tags): each id's keys, the busiest first; only the hits' keys are looked at."""
    keys = ids.join(index.records.select("id", "ekeys"), "id").select("id", F.explode("ekeys").alias("key"))
    busy = keys.join(index.counts, "key")
    return busy.groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "key")))["key"].alias("tags"))
