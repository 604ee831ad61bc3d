"""Passage dedup: repeated chunks as in line dedup, and every repeated passage of some lines and more than MAX_WORDS words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, maybe_in, saved, spread_join, word_count
from .line_dedup import MIN_LINES, ends

#: A repeated passage of more words than this, over two lines or more, is found wherever it begins and ends.
MAX_WORDS = 50
#: Size of the map of repeated hashes.
MAP_BITS = 1 << 25
_LOW = (1 << 32) - 1


def line_ranges(lines: Column) -> Column:
    """array<struct<start, end>>: the ranges of lines, from 1, that are looked up elsewhere.

    These are the chunks of MIN_LINES lines or more, and for each line with words the shortest window of two such lines or more and
    over MAX_WORDS words that starts there, and the one that ends there. A passage over MAX_WORDS words is the union of the
    windows inside it, so no boundary has to fall into it. A window has at most MAX_WORDS + 1 lines with words.
    """

    def range_(start: Column, end: Column) -> Column:
        """As one number: the union of numbers is taken by hash, that of structs by comparing all with all."""
        return F.shiftleft(start.cast("long"), 32) + end.cast("long")

    def of_chunks(e: Column) -> Column:
        all_ = F.transform(e, lambda end, k: range_(F.when(k == 0, F.lit(1)).otherwise(F.try_element_at(e, F.greatest(k, F.lit(1))) + 1), end))
        return F.filter(all_, lambda r: F.shiftright(r, 32) + MIN_LINES <= r.bitwiseAND(F.lit(_LOW)) + 1)

    def reach(words: Column) -> Column:
        """Number of the leading lines that make a window; 0 where they are too few."""
        none = F.struct(F.lit(0).cast("long").alias("w"), F.lit(0).alias("n"))
        more = lambda a, w: F.when((a["w"] > MAX_WORDS) & (a["n"] >= 2), a).otherwise(F.struct((a["w"] + w).alias("w"), (a["n"] + 1).alias("n")))
        return F.aggregate(words, none, more, lambda a: F.when((a["w"] > MAX_WORDS) & (a["n"] >= 2), a["n"]).otherwise(0))

    def windows(full: Column) -> Column:
        """full: array<struct<i, w>> of the lines with words."""
        words = lambda part: F.transform(part, lambda x: x["w"])
        at = lambda k: F.try_element_at(full, F.greatest(k, F.lit(1)))["i"]

        def both(x: Column, k: Column) -> Column:
            ahead = reach(words(F.slice(full, k + 1, MAX_WORDS + 1)))
            first = F.greatest(k + 1 - MAX_WORDS, F.lit(1))
            back = reach(words(F.reverse(F.slice(full, first, k + 2 - first))))
            starting = let(ahead, lambda n: F.when(n > 0, range_(x["i"], at(k + n))))
            ending = let(back, lambda n: F.when(n > 0, range_(at(k + 2 - n), x["i"])))
            return F.array(starting, ending)

        return F.filter(F.flatten(F.transform(full, both)), lambda r: r.isNotNull())

    full = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), word_count(x).alias("w"))), lambda x: x["w"] > 0)
    chunks = let(F.transform(lines, lambda x: F.md5(x)), lambda digests: let(ends(digests), of_chunks))
    return F.transform(F.array_union(chunks, let(full, windows)), lambda r: F.struct(F.shiftright(r, 32).cast("int").alias("start"), r.bitwiseAND(F.lit(_LOW)).cast("int").alias("end")))


def _left(lines: Column, gone: Column) -> Column:
    """The lines outside the ranges gone; one look at each line of each range."""
    stays = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.flatten(F.transform(gone, lambda r: F.sequence(r["start"], r["end"]))))
    return F.transform(stays, lambda i: F.element_at(lines, i))


def passage_dedup(docs: DataFrame) -> DataFrame:
    """Remove every line that lies in a range (line_ranges) which stands elsewhere too, but for the range's first place.

    Ranges meet by hash first; those whose hash occurs twice are compared byte by byte (grouped by the text itself). The place
    with the smallest (doc_id, first line) stays. Ranges that overlap their own first place lose the lines after it only, so one
    copy of a periodic text stays. A line that goes has an equal one at a smaller place, so every line stays somewhere. Returns
    docs with text replaced, and lines_in, lines_removed. Nulls, empty texts and repeated rows are decided as in line_dedup.
    """
    kept = [c for c in docs.columns if c not in ("lines_in", "lines_removed")]
    lines = F.split("text", "\n")

    def piece(all_: Column, r: Column) -> Column:
        return F.array_join(F.slice(all_, r["start"], r["end"] - r["start"] + 1), "\n")

    keyed = let(lines, lambda all_: F.transform(line_ranges(all_), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.xxhash64(piece(all_, r)).alias("key"))))
    # The ranges are found twice, as keeping them beside their texts would take the disk of all texts; only those whose hash may occur again become rows that move.
    # A range's row holds its own lines only, so the work grows with the lines of a text.
    whole = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("whole"), keyed.alias("ranges"))
    again = whole.select(F.explode("ranges.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut_out = let(lines, lambda all_: F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["key"].alias("key"), piece(all_, r).alias("piece"))))
    ranges = whole.select("doc_id", "whole", F.explode(cut_out).alias("r")).select("doc_id", "whole", "r.*")
    seen = saved(maybe_in(ranges, F.col("key"), again, F.col("key"), MAP_BITS), "passages-seen")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "start"))).alias("first")
    same = seen.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1 AND first IS NOT NULL").drop("n")
    first_end = F.col("first.start") + F.col("end") - F.col("start")
    over = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") <= first_end)
    cut = F.struct(F.when(over, first_end + 1).otherwise(F.col("start")).alias("start"), F.col("end").alias("end"))
    gone = (
        spread_join(seen, same, ["key", "piece"], ["doc_id", "start"])
        .where(F.col("doc_id").isNotNull() & (F.struct("doc_id", "start") != F.col("first")))
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("whole").alias("gone_whole"))
        .agg(F.collect_set(cut).alias("gone"))
    )
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in kept if c != "text"]).alias("row"))
    joined = rows.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_whole")), "left")
    left = let(lines, lambda all_: _left(all_, F.col("gone")))
    out = joined.withColumn("left", F.when(F.col("gone").isNotNull(), left))
    n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("left", "\n"))
    return out.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        n.alias("lines_in"),
        F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n - F.size("left")).cast("long").alias("lines_removed"),
    )


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return passage_dedup(docs).select("doc_id", "text", "lines_in", "lines_removed")
