"""Line dedup: globally repeated multi-line chunks with content-defined boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, maybe_in, saved, spread_join

#: A boundary follows a line if the rolling hash over WINDOW line hashes is 0 modulo EVERY.
WINDOW, EVERY = 2, 3
#: Size of the map of repeated hashes.
MAP_BITS = 1 << 23
#: A chunk of fewer lines is never removed.
MIN_LINES = 2


def ends(digests: Column) -> Column:
    """Numbers of the lines that close a chunk, from 1, by the digests of all lines."""

    def closes(i: Column) -> Column:
        rolled = F.md5(F.concat(*[F.coalesce(F.try_element_at(digests, F.greatest(i - j, F.lit(1))), F.lit("")) for j in reversed(range(WINDOW))]))
        return (F.conv(F.substring(rolled, 1, 6), 16, 10).cast("long") % EVERY == 0) | (i == F.size(digests))

    return F.filter(F.sequence(F.lit(1), F.size(digests)), closes)


def line_chunks(text: Column) -> Column:
    """array<struct<pos, n_lines, chunk>>: the lines of text in chunks, in order.

    The rolling hash of a line covers its own hash and that of the line before, so a boundary depends on
    nothing further up and survives lines put in or taken out above it. Null gives an empty array.
    """

    def cut(lines: Column) -> Column:
        digests = F.transform(lines, lambda x: F.md5(x))
        return let(digests, lambda d: let(ends(d), lambda e: F.transform(e, lambda end, k: chunk(lines, e, end, k))))

    def chunk(lines: Column, ends_: Column, end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(1)).otherwise(F.try_element_at(ends_, F.greatest(k, F.lit(1))) + 1)
        own = F.slice(lines, start, end - start + 1)
        return F.struct(k.alias("pos"), (end - start + 1).alias("n_lines"), F.array_join(own, "\n").alias("chunk"))

    empty = F.array().cast("array<struct<pos:int,n_lines:int,chunk:string>>")
    return F.when(text.isNull(), empty).otherwise(let(F.split(text, "\n"), cut))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Remove every multi-line chunk that stands elsewhere too, but for its first place.

    Chunks meet by their hash first; those whose hash occurs twice are compared byte by byte (grouped by
    the text itself). The place with the smallest (doc_id, position) stays. Returns docs with text replaced, and lines_in,
    lines_removed. Decided cases: a null text stays null with 0 lines, an empty text is one empty line; rows with a null
    doc_id have no place, so they count as repeats but are never cut; rows that repeat a doc_id and
    position are both first, and both stay; columns named lines_in or lines_removed are replaced, all others kept, whatever their
    names; an empty table gives no rows. Hot chunks: counts are partial sums before the shuffle, and places of one chunk are dealt
    over several tasks where they meet their first place.
    """
    kept = [c for c in docs.columns if c not in ("lines_in", "lines_removed")]
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in kept if c != "text"]).alias("row"))
    pieces = rows.select("doc_id", F.explode(line_chunks(F.col("text"))).alias("c")).select("doc_id", "c.*").where(F.col("n_lines") >= MIN_LINES)
    pieces = pieces.withColumn("key", F.xxhash64("chunk"))
    # Only pieces whose hash may occur again take their text along.
    again = pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    seen = saved(maybe_in(pieces, F.col("key"), again, F.col("key"), MAP_BITS), "lines-seen")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first")
    same = seen.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"), first).where("n > 1 AND first IS NOT NULL")
    gone = (
        spread_join(seen, same, ["key", "chunk"], ["doc_id", "pos"])
        .where(F.col("doc_id").isNotNull() & (F.struct("doc_id", "pos") != F.col("first")))
        .groupBy(F.col("doc_id").alias("gone_id"))
        .agg(F.collect_set(F.struct("pos", "key")).alias("gone"))
    )
    joined = rows.join(gone, F.col("doc_id") == F.col("gone_id"), "left")
    out = joined.withColumn("chunks", line_chunks(F.col("text")))
    stays = F.filter("chunks", lambda c: (c["n_lines"] < MIN_LINES) | ~F.array_contains("gone", F.struct(c["pos"].alias("pos"), F.xxhash64(c["chunk"]).alias("key"))))
    lines = lambda name: F.aggregate(name, F.lit(0), lambda a, c: a + c["n_lines"])
    out = out.withColumn("left", F.when(F.col("gone").isNull(), F.col("chunks")).otherwise(stays))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.col("left")["chunk"], "\n"))
    return out.select(
        *[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in kept],
        lines("chunks").cast("long").alias("lines_in"),
        (lines("chunks") - lines("left")).cast("long").alias("lines_removed"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "text", "lines_in", "lines_removed")


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), rolled AS (
  SELECT *, md5(coalesce(lag(md5(line)) OVER w, md5(line)) || md5(line)) AS roll, max(i) OVER (PARTITION BY doc_id) AS n
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), closing AS (
  SELECT *, (('0x' || substr(roll, 1, 6))::BIGINT % 3 = 0 OR i = n)::INT AS closes FROM rolled
), numbered AS (
  SELECT *, coalesce(sum(closes) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM closing
), chunks AS (
  SELECT doc_id, pos, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY doc_id, pos
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) AS place FROM chunks
), kept AS (
  SELECT *, n_lines < 2 OR place = 1 AS stays FROM placed
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(k.chunk, chr(10) ORDER BY k.pos) FILTER (k.stays), '') END AS text,
       coalesce(sum(k.n_lines), 0)::BIGINT AS lines_in, coalesce(sum(k.n_lines) FILTER (NOT k.stays), 0)::BIGINT AS lines_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id GROUP BY d.doc_id, d.text
"""
