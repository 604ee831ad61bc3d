"""Phrase collocations by stripes: each prefix keys an associative counter of next words, and stripes are merged element by element.

Texts are read in three rounds: words (the stripe of the empty prefix), pairs of frequent words, and longer phrases all of whose pairs are frequent. A phrase
that occurs often enough has frequent parts only, so later rounds lose none; what is frequent goes to the tasks as a bit map of a fixed size, which at worst lets
more through. Counts of phrases, of what extends them, and of what they start with are all looked up in the merged stripes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, spread_join

#: A-Z lower-cased, and what ends a piece made a full stop, which no word holds.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
_BLANK = re.compile(rb"[ \t.]")
#: Bytes of a text that are split at once, and bytes after which a task emits its stripes.
WINDOW, CHUNK = 1 << 22, 1 << 23
#: Entries of stripes that are merged at once, and stripes in a batch.
ENTRIES, ROWS = 1 << 19, 1 << 15
#: Bits of the map of frequent phrases.
BITS = 1 << 26
#: Parts of the empty prefix's stripe. Of other prefixes those with over 1 / HOT of all words, and over HOT_WORDS, have parts in proportion.
ROOT_PARTS, HOT, HOT_WORDS = 1 << 12, 1 << 12, 1 << 16
#: Salts of a language's phrases when its best are found.
SALTS = 256
#: next holds words parted by blanks, n their counts likewise, or null if all are 1.
_STRIPE = "lang string, size int, prefix string, part int, next string, n string"
_ARROW = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("prefix", pa.string()), ("part", pa.int32()), ("next", pa.string()), ("n", pa.string())])
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(seed: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of what is before its last word and of that word."""
    h = (seed ^ (seed >> np.uint64(29)) ^ word) * _MULTIPLY
    return h ^ (h >> np.uint64(32))


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _distinct(values: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, all below bound, in order, and where each of values is among them."""
    if bound > 4 * len(values):
        return np.unique(values, return_inverse=True)
    there = np.zeros(bound, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


class Chunk:
    """Tokens of some rows (language, folded text, words that were counted before).

    words are distinct by language, with their number in langs; flat has the number of each token's word, -1 ends a piece. Places in old give context only.
    """

    def __init__(self, rows: list[tuple[str, bytes, int]]):
        self.names = sorted({r[0] for r in rows})
        number = {x: i for i, x in enumerate(self.names)}
        texts = pa.array([r[1] + b"." for r in rows], pa.large_binary()).view(pa.large_string())
        split = pa.compute.ascii_split_whitespace(pa.compute.replace_substring(texts, pattern=".", replacement=" . "))
        encoded = split.flatten().dictionary_encode()
        at, known = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
        row = np.repeat(np.arange(len(rows)), pa.compute.list_value_length(split).to_numpy())
        full = at != pa.compute.index(known, "").as_py()  # blanks at an end
        at, row = at[full], row[full]
        lang = np.array([number[r[0]] for r in rows], np.int64)[row]
        word = at != pa.compute.index(known, ".").as_py()
        codes, of = _distinct(lang[word] * len(known) + at[word], len(self.names) * len(known))
        self.flat = np.full(len(at), -1, np.int64)
        self.flat[word] = of
        self.langs, own = codes // max(len(known), 1), codes % max(len(known), 1)
        self.words = known.take(pa.array(own)).cast(pa.string())
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known.to_pylist()), np.uint64, len(known))
        self.plain = hashes[own]
        self.old = np.zeros(len(at), bool)
        for i, (_, _, n) in enumerate(rows):
            if n:
                first = int(np.searchsorted(row, i))
                self.old[first : first + n] = True

    @property
    def hashes(self) -> np.ndarray:
        """Hashes of the phrases that are one word."""
        return _mixed(np.array([_hash(x.encode()) for x in self.names], np.uint64)[self.langs], self.plain)


def windows(data: bytes, context: int) -> Iterator[tuple[bytes, int]]:
    """A folded text in parts of WINDOW bytes, cut between words. The last words of an open piece stand in front of the next part again; their number follows."""
    start, before = 0, b""
    while start < len(data) or not start:
        stop = start + WINDOW
        if stop < len(data):
            stop = m.start() if (m := _BLANK.search(data, stop)) else len(data)
        tail = before.rpartition(b".")[2].split()[-context:] if context and start else []
        before = b" ".join([*tail, data[start:stop]])
        yield before, len(tail)
        start = max(stop, 1)


def chunks(batches: Iterator[pa.RecordBatch], context: int) -> Iterator[Chunk]:
    """Tokens of (lang, text) rows, CHUNK bytes at a time or little more."""
    rows: list[tuple[str, bytes, int]] = []
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            raw = text.as_buffer()
            for part, old in windows(raw.to_pybytes().translate(_FOLD) if raw is not None else b"", context):
                rows.append((lang, part, old))
                size += len(part)
                if size >= CHUNK:
                    yield Chunk(rows)
                    rows, size = [], 0
    if rows:
        yield Chunk(rows)


class Sieve:
    """A map of BITS bits of the phrases that are frequent, and the parts of stripes that are hot; both of bounded size."""

    def __init__(self, bits: np.ndarray, hot: dict[tuple[str, str], int]):
        self.bits, self.hot = bits, hot

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(BITS - 1)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    def parts(self, langs: pa.Array, phrases: pa.Array) -> np.ndarray:
        """Parts of the stripes that phrases are the prefix of."""
        out = np.ones(len(phrases), np.int64)
        if self.hot:
            for i in np.flatnonzero(pa.compute.is_in(phrases, value_set=pa.array(sorted({p for _, p in self.hot}), pa.string()))):
                out[i] = self.hot.get((langs[int(i)].as_py(), phrases[int(i)].as_py()), 1)
        return out


def _emitted(size: int, lang: pa.Array, prefix: pa.Array, part: np.ndarray, firsts: np.ndarray, following: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes: runs of (following, n) that begin at firsts, under their prefix."""
    if not len(firsts):
        return
    offsets = np.r_[firsts, len(n)].astype(np.int32)
    more = np.flatnonzero(np.maximum.reduceat(n, firsts) > 1)
    some = np.repeat(np.isin(np.arange(len(firsts)), more), np.diff(offsets))
    sizes = np.diff(offsets)[more]
    told = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(n[some]).cast(pa.string())), " ")
    at = np.full(len(firsts), -1)
    at[more] = np.arange(len(more))
    joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(offsets), following), " ")
    whole = pa.RecordBatch.from_arrays(
        [lang, pa.array(np.full(len(firsts), size), pa.int32()), prefix, pa.array(part, pa.int32()), joined, told.take(pa.array(at, mask=at < 0))], schema=_ARROW
    )
    for first in range(0, len(firsts), ROWS):
        yield whole.slice(first, ROWS)


def word_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stripe of the empty prefix, in parts, and at size 0 the number of all words."""
    for chunk in chunks(batches, 0):
        n = np.bincount(chunk.flat[chunk.flat >= 0], minlength=len(chunk.words))
        if not len(n):
            continue
        part = (chunk.plain & np.uint64(ROOT_PARTS - 1)).astype(np.int64)
        order = np.lexsort((part, chunk.langs))
        lang, part = chunk.langs[order], part[order]
        firsts = np.flatnonzero(np.r_[True, (np.diff(lang) != 0) | (np.diff(part) != 0)])
        names, empty = pa.array(chunk.names, pa.string()), lambda k: pa.array([""] * k, pa.string())
        yield from _emitted(1, names.take(pa.array(lang[firsts])), empty(len(firsts)), part[firsts], firsts, chunk.words.take(pa.array(order)), n[order])
        totals = np.bincount(lang, n[order], len(names)).astype(np.int64)
        own = np.flatnonzero(totals)
        yield from _emitted(0, names.take(pa.array(own)), empty(len(own)), np.full(len(own), -1), np.arange(len(own)), empty(len(own)), totals[own])


def phrase_stripes(batches: Iterator[pa.RecordBatch], words: Sieve, pairs: Sieve | None, longest: int) -> Iterator[pa.RecordBatch]:
    """Stripes of words that are frequent, or, where pairs are given, of phrases of two words or more all of whose pairs are."""
    for chunk in chunks(batches, longest - 1):
        plain, hashes, flat, text = chunk.plain, chunk.hashes, chunk.flat, chunk.words
        m = len(plain)
        at = np.where(words.has(hashes)[flat], flat, -1) if m else flat  # the place -1 ends a piece
        at[flat < 0] = -1
        langs = pa.array(chunk.names, pa.string()).take(pa.array(chunk.langs))
        # Of the phrases one word shorter: their number where they end, their text, hash and the parts of their stripe.
        before, heads, seeds = at, text, hashes
        parts = words.parts(langs, text)
        pair_at = None
        for size in range(2, longest + 1):
            goes = np.flatnonzero((before[:-1] >= 0) & (at[1:] >= 0) & (True if pair_at is None else pair_at[1:] >= 0)) + 1
            codes, of = np.unique(before[goes - 1] * m + at[goes], return_inverse=True)
            prefix, last = codes // max(m, 1), codes % max(m, 1)
            if pairs is None or size > 2:
                n = np.bincount(of[~chunk.old[goes]], minlength=len(codes))
                part = (plain[last] % parts[prefix].astype(np.uint64)).astype(np.int64)
                order = np.lexsort((part, prefix))
                order = order[n[order] > 0]
                firsts = np.flatnonzero(np.r_[len(order) > 0, (np.diff(prefix[order]) != 0) | (np.diff(part[order]) != 0)])
                first = order[firsts]
                yield from _emitted(size, langs.take(pa.array(last[first])), heads.take(pa.array(prefix[first])), part[first], firsts, text.take(pa.array(last[order])), n[order])
            if size == longest:
                break
            seeds = _mixed(seeds[prefix], plain[last])
            heads = pa.compute.binary_join_element_wise(heads.take(pa.array(prefix)), text.take(pa.array(last)), " ")
            before = np.full(len(at), -1, np.int64)
            if size == 2:
                known = pairs.has(seeds)
                before[goes[known[of]]] = of[known[of]]
                pair_at = before
                parts = pairs.parts(langs.take(pa.array(last)), heads)
            else:
                before[goes] = of
                parts = parts[prefix]


def merged(stripes: DataFrame, least: int) -> DataFrame:
    """(lang, size, phrase, n): stripes of one prefix merged element by element; what occurs least times or more, and totals.

    A part of a prefix's stripe is in one task, where its stripes follow one another; a task holds ENTRIES of them and one merged part at a time.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in merge_sorted(batches):
            some = pa.compute.or_(pa.compute.greater_equal(done["n"], least), pa.compute.equal(done["size"], 0))
            yield from done.filter(some).select(["lang", "size", "prefix", "next", "n"]).to_batches()

    keys = ["lang", "size", "prefix", "part"]
    sums = stripes.repartition("lang", "prefix", "part").sortWithinPartitions(*keys).mapInArrow(merge, "lang string, size int, prefix string, next string, n long")
    return sums.select("lang", "size", F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next")).alias("phrase"), "n")


def merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Counters (lang, size, prefix, part, next, n) of stripes that come sorted by the first four, each told once."""
    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            words = pa.compute.split_pattern(part.column("next"), " ")
            lengths = pa.compute.list_value_length(words).to_numpy()
            n = np.ones(int(lengths.sum()), np.int64)
            told = part.column("n")
            n[np.repeat(told.is_valid().to_numpy(zero_copy_only=False), lengths)] = pa.compute.split_pattern(told.drop_null(), " ").flatten().cast(pa.int64()).to_numpy()
            flat = pa.Table.from_batches([part]).select(["lang", "size", "prefix", "part"]).take(pa.array(np.repeat(np.arange(part.num_rows), lengths)))
            held.append(flat.append_column("next", words.flatten()).append_column("n", pa.array(n)))
            size += len(n)
            if size >= ENTRIES:
                done, rest = _summed(held, last_open=True)
                yield done
                held, size = [rest], 0  # an open part counts from its next entries on
    if held:
        yield _summed(held, last_open=False)[0]


def _summed(held: list[pa.Table], last_open: bool) -> tuple[pa.Table, pa.Table]:
    """The sums of all stripes, and those of the last one, whose other stripes may follow."""
    table = pa.concat_tables(held)
    keys = ["lang", "size", "prefix", "part"]
    # Runs of equal keys get numbers, so that entries are told apart by two numbers.
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        col = table[k].combine_chunks()
        new[1:] |= pa.compute.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
    run = np.cumsum(new) - 1
    words = table["next"].combine_chunks().dictionary_encode()
    at = words.indices.to_numpy().astype(np.int64)
    codes, first, of = np.unique(run * max(len(words.dictionary), 1) + at, return_index=True, return_inverse=True)
    n = np.zeros(len(codes), np.int64)
    np.add.at(n, of, table["n"].to_numpy())
    out = table.select([*keys, "next"]).take(pa.array(first)).append_column("n", pa.array(n))
    open_ = int(np.searchsorted(run[first], run[-1])) if last_open and len(run) else len(codes)
    return out.slice(0, open_), out.slice(open_)


def sieve(found: DataFrame, size: int, total: int) -> Broadcast:
    """The phrases of a size that are frequent. What reaches the driver is a row for each word of 64 bits at most, and HOT phrases."""
    spark = found.sparkSession

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True):
                h = np.array([_hash(lang.encode())], np.uint64)
                for word in phrase.encode().split(b" "):
                    h = _mixed(h, np.array([_hash(word)], np.uint64))
                out.append(int(h[0]) & (BITS - 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["place"])

    own = found.where(F.col("size") == size)
    at = own.select("lang", "phrase").mapInArrow(places, "place long")
    rows = at.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(BITS >> 6, np.int64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    share = max(total // HOT, HOT_WORDS)
    hot = {(r.lang, r.phrase): -(-r.n // share) for r in own.where(F.col("n") > share).select("lang", "phrase", "n").collect()}
    return spark.sparkContext.broadcast(Sieve(bits.view(np.uint64), hot))


def phrases(docs: DataFrame, least: int, longest: int) -> DataFrame:
    """(lang, size, phrase, n): all phrases of up to longest words that occur least times or more, and under size 0 the number of words of each language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = saved(merged(texts.mapInArrow(word_stripes, _STRIPE), least), "phrases-1")
    if longest < 2:
        return words
    total = words.where("size = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = sieve(words, 1, total)
    two = saved(merged(texts.mapInArrow(lambda b: phrase_stripes(b, known.value, None, 2), _STRIPE), least), "phrases-2")
    if longest == 2:
        return words.unionByName(two)
    pairs = sieve(two, 2, total)
    more = saved(merged(texts.mapInArrow(lambda b: phrase_stripes(b, known.value, pairs.value, longest), _STRIPE), least), "phrases-more")
    return reduce(DataFrame.unionByName, [words, two, more])


def scored(found: DataFrame, longest: int, subsumed: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more that no longer one holds subsumed hundredths of.

    Each way of cutting a phrase in two looks both parts up. A phrase of more words occurs at most as often as what it holds, so that of the longer ones those with one word more
    decide: its own stripe's largest count, and that of the stripes that it ends.
    """
    count = F.col("n").cast("decimal(20,0)")
    candidates = found.where("size >= 2")
    cut = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    asked = candidates.select("lang", "phrase", "size", "n", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    asked = asked.select("*", F.explode(F.array(F.struct(F.lit("l").alias("side"), cut(F.col("k")).alias("piece")), F.struct(F.lit("r").alias("side"), cut(F.col("k") - F.col("size")).alias("piece")))).alias("x"))
    asked = asked.select("lang", "phrase", F.col("n").alias("a"), "k", "x.*")
    known = found.where("size > 0").select("lang", F.col("phrase").alias("piece"), F.col("n").alias("held"))
    both = spread_join(asked, known, ["lang", "piece"], ["phrase", "k"]).groupBy("lang", "phrase", "a")
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("held"))).alias(f"{s}{k}") for k in range(1, longest) for s in "lr"]
    score = lambda k: F.expr(f"cast(a as decimal(20,0)) * 2000000 div (cast(l{k} as decimal(20,0)) + cast(r{k} as decimal(20,0)))")
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    best = both.agg(*sides).select("lang", "phrase", "a", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull())).alias("best"))
    inside = candidates.where("size >= 3").select("lang", F.explode(F.array(cut(F.col("size") - 1), cut(1 - F.col("size")))).alias("phrase"), "n")
    longer = inside.groupBy("lang", "phrase").agg(F.max(count).alias("longer"))
    stays = F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a").cast("decimal(20,0)") * subsumed)
    return best.join(longer, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def best_of(rows: DataFrame, order: list[Column], top: int) -> DataFrame:
    """The first top rows of each language, with rank. They are among the first of each of SALTS parts, so no task orders a language whole."""
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, subsumed: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's top phrases of 2 to longest words that occur least times or more.

    A text is lower-cased (A-Z) and split into pieces at punctuation and line ends, and these at spaces and tabs; a phrase lies inside a piece, and overlapping occurrences count. Of the
    cuts in two the one with the lowest score counts, then the earliest. Phrases that a longer one holds subsumed hundredths of go. Order: score, then a descending, phrase by bytes.

    Decided cases: null texts are empty; a null lang is 'und', like those called so; repeated rows count each; texts are read whole, WINDOW bytes at a time; an empty table, and
    one without frequent phrases, give no rows; other columns are left out, whatever their names.
    """
    found = phrases(docs, least, longest)
    best = best_of(scored(found, longest, subsumed), [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    totals = found.where("size = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


OP12_SQL = """
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) s(size) WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT *, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS p, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS q
  FROM (SELECT *, unnest(range(1, size)) AS k FROM f WHERE size >= 2)
), scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.p JOIN f y ON y.lang = c.lang AND y.phrase = c.q
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ AS (
  SELECT lang, a, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size >= 3))
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM inner_ GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, t.n::BIGINT AS n, b.score
FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase JOIN totals t ON t.lang = b.lang
WHERE g.a IS NULL OR 100 * g.a < 80 * b.a
QUALIFY rank <= 2000
"""
