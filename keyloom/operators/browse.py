"""Browsing: search, vocabulary, tags, timeline, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_date_range, snippet
from ..spread import dealt, parts_for
from . import views
from .index import Index
from .recall import recall


def find(lines: DataFrame, needle: str) -> DataFrame:
    """Links whose value holds needle, case and all; an empty needle is in every value."""
    return lines.where(F.col("value").contains(needle))


def text_lines(docs: DataFrame, path: str, text: str) -> DataFrame:
    """(path, line, text) of every line of every text; lines count from 1."""
    return docs.select(F.col(path).alias("path"), F.posexplode(F.split(text, "\n")).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def grep(lines: DataFrame, pattern: str, limit: int = 200) -> DataFrame:
    """The first lines that match, by path and line number: a report of bounded length."""
    return lines.where(F.col("text").rlike(pattern)).orderBy("path", "line").limit(limit)


def glob_pattern(glob: str) -> str:
    special = {"*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(special.get(c, c if c.isalnum() or c in "_/-" else "\\" + c) for c in glob) + "$"


def glob_list(paths: DataFrame, glob: str, limit: int = 300) -> DataFrame:
    return paths.where(F.col("path").rlike(glob_pattern(glob))).select("path").distinct().orderBy("path").limit(limit)


def key_vocabulary(postings: DataFrame) -> DataFrame:
    return postings.select("key").distinct()


def tags(postings: DataFrame, after: tuple[int, str] | None = None, limit: int | None = None) -> DataFrame:
    """(key, n), most records first, then by key; after and limit make a keyset page."""
    n = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if after:
        n = n.where((F.col("n") < after[0]) | ((F.col("n") == after[0]) & (F.col("key") > after[1])))
    return n.orderBy(F.desc("n"), "key").limit(limit) if limit else n


def timeline(shown: DataFrame, before: int | None = None, limit: int | None = 500, first: str | None = None, last: str | None = None) -> DataFrame:
    """Records by id from the newest, first link only, with visible keys."""
    rows = views.first_link(shown).where(in_date_range(F.col("ts"), first, last))
    if before is not None:
        rows = rows.where(F.col("id") < before)
    rows = rows.select("id", "ts", F.array_join("keys", " ").alias("keys"), "value", "extra")
    return rows.orderBy(F.desc("id")).limit(min(limit, 10_000)) if limit else rows


def newest(lines: DataFrame, tomb: DataFrame, ktomb: DataFrame, limit: int = 500) -> DataFrame:
    """The first page of the timeline from the record tables: its ids first, so that only their links are met with keys, shuffled and ordered."""
    alive = views.live(dealt(lines.select("id"), parts_for(lines), "id"), tomb).distinct()
    ids = F.broadcast(alive.orderBy(F.desc("id")).limit(min(limit, 10_000)))
    page = views.visible(lines.join(ids, "id", "left_semi"), ktomb.join(ids, "id", "left_semi"))
    return timeline(page, limit=limit)


def timeline_stored(index: Index, before: int | None = None, limit: int | None = 500, first: str | None = None, last: str | None = None) -> DataFrame:
    """The same from a stored index: bounds on id and day reach the scan, whose files are in order of ids."""
    rows = index.records
    if first or last:
        rows = rows.where("ts <> ''")
    # A time of a day is at or above the day itself and below the day with a character beyond all that follow it.
    if first:
        rows = rows.where(F.col("ts") >= first[:10])
    if last:
        rows = rows.where(F.col("ts") < last[:10] + "~")
    if before is not None:
        rows = rows.where(F.col("id") < before)
    rows = rows.select("id", "ts", F.array_join("keys", " ").alias("keys"), "value", "extra")
    return rows.orderBy(F.desc("id")).limit(min(limit, 10_000)) if limit else rows


def day_groups(shown: DataFrame, zone: str = "UTC") -> DataFrame:
    """Records per day of the viewer's zone; a bare date counts as it is."""
    ts = F.col("ts")
    at = F.try_to_timestamp(F.substring(F.regexp_replace(ts, "Z$", ""), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    day = F.when(F.length(ts) == 10, ts).otherwise(F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd"), F.lit("(undated)")))
    return views.first_link(shown).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))


def stats(lines: DataFrame, tomb: DataFrame, all_postings: DataFrame) -> DataFrame:
    """records, keys (those of dead records too) and deleted, in one row."""
    records = count_live(lines, tomb).withColumnRenamed("n", "records")
    keys = all_postings.agg(F.countDistinct("key").alias("keys"))
    deleted = tomb.agg(F.countDistinct("id").alias("deleted"))
    return records.crossJoin(keys).crossJoin(deleted)  # one row each


def count_live(lines: DataFrame, tomb: DataFrame) -> DataFrame:
    return views.live(lines.select("id").distinct(), tomb).agg(F.count(F.lit(1)).alias("n"))


def delete_preview(shown: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first records under a key with a snippet, their further links, and how many there are in all."""
    under = views.first_link(shown).join(recall(shown, [key]), "id")
    total = under.agg(F.count(F.lit(1)).alias("total"))
    return under.select("id", snippet(F.col("value")).alias("snippet"), "extra").orderBy("id").limit(limit).crossJoin(total)  # total has one row


def posting_profile(postings: DataFrame, hot: int = 100_000) -> DataFrame:
    n = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("keys"),
        F.max("n").alias("hottest"),
        F.min("n").alias("rarest"),
        F.expr("percentile(n, 0.5)").alias("median"),
        F.count_if(F.col("n") > hot).alias("over_hot"),
    )


def next_id(lines: DataFrame, tomb: DataFrame) -> DataFrame:
    both = lines.select("id").unionAll(tomb.select("id"))
    return both.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def ordered_distinct(rows: DataFrame, column: str, order: str) -> DataFrame:
    return rows.groupBy(column).agg(F.min(order).alias("first_at"))


def bytes_by(docs: DataFrame, root: str, text: str) -> DataFrame:
    return docs.groupBy(root).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.octet_length(text), F.lit(0))).cast("long").alias("bytes"))


def deleted_runs(tomb: DataFrame) -> DataFrame:
    """Tombstone entries that start a new id, in the order of the log."""
    w = Window.partitionBy("id").orderBy("ord")
    return tomb.withColumn("again", F.lag("id").over(w).isNotNull()).where("NOT again").select("id", "ts")
