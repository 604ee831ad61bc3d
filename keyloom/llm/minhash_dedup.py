"""MinHash near-dedup by a join on signature coordinates.

The steps, each on all rows that the step before kept:

1. Texts become sets of shingle hashes; texts with the same set are one class, which its smallest doc_id stands for.
2. A class's signature has COORDINATES coordinates: the smallest hash among those with the same leading 8 bits. Coordinates without a
   hash are left out, so a short text's signature is nearly its set. A share of s of two classes' coordinates is expected to agree
   at similarity s, with a deviation of 0.025 at most; classes link only if SHARE of those that either has agree, 4 deviations below 0.8.
3. Post: every class is posted under each of its coordinate values; counts and the smallest holder (the hub) are one aggregation.
   Prefix: classes that agree in SHARE of their coordinates share one of the rarest 1 - SHARE of each, so only these stay posted.
   Skip: a value that no other class has is never posted. A template's values are common, so pages that only share it skip one another.
4. Each posting list is joined to its hub instead of to all pairs; these pairs are confirmed on the full sets and merged to components.
5. Lists that still span components are walked in pairs of blocks of bounded size, members of a list's largest component against the
   others only. A task counts the agreeing coordinates on 4-bit sketches of the signatures, which never hides a pair of step 2, and tells
   a spanning forest of the pairs that agree enough: fewer rows than members. Whatever such a forest joins is a family, in which every
   document takes part once; families are walked like lists, on full sets, and a task tells only links that join what its earlier links don't.
   So no link between different texts is lost to the shortcut of step 4, and nobody emits all pairs of a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, marked, maybe_in, saved, spread_join, unused
from .words import WordHashes, hashes_of, slices

#: Number of coordinates (by leading bits of a hash), and the percentage of them in which linked classes agree.
COORDINATES, SHARE = 256, 70
#: Members of a list that are compared with as many others at a time.
BLOCK = 512
#: Sizes of the maps of coordinate values that are shared, and of doc_ids whose sets are compared.
VALUE_BITS, ID_BITS = 1 << 26, 1 << 23
_PAGE = 1 << 12
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text, A-Z lower-cased.

    Fewer than n words make one shingle of all; no words, or null, make none.
    """
    words, sizes = hashes_of(texts, known)
    ends = np.cumsum(sizes)
    # The hash of the n words from each place on, which is a shingle unless it runs over the text's end.
    rolled = np.zeros(len(words), np.uint64)
    for i in range(n):
        rolled = (rolled ^ np.r_[words[i:], np.zeros(min(i, len(words)), np.uint64)]) * _MIX
        rolled ^= rolled >> np.uint64(31)
    out = []
    for end, size in zip(ends, sizes, strict=True):
        if size >= n:
            out.append(np.unique(rolled[end - size : end - n + 1]))
        elif size:
            whole = np.array([size], np.uint64)
            for w in words[end - size : end]:
                whole = (whole ^ w) * _MIX
                whole ^= whole >> np.uint64(31)
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The coordinates of a set: of sorted hashes, the first with each value of the leading bits."""
    lead = shingles >> np.uint64(64 - COORDINATES.bit_length() + 1)
    return shingles[np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]])] if len(shingles) else shingles


def sketch(coordinates: np.ndarray) -> np.ndarray:
    """4 bits for each coordinate: its hash modulo 15, and 15 for none; two to a byte."""
    out = np.full(COORDINATES, 15, np.uint8)
    out[(coordinates >> np.uint64(64 - COORDINATES.bit_length() + 1)).astype(np.int64)] = ((coordinates & np.uint64(0xFFFFFFFF)) % np.uint64(15)).astype(np.uint8)
    return out[::2] << np.uint8(4) | out[1::2]


class Sketches:
    """Sketches of a group's members, by rows."""

    def __init__(self, packed: np.ndarray):
        flat = np.empty((len(packed), COORDINATES), np.uint8)
        flat[:, ::2], flat[:, 1::2] = packed >> np.uint8(4), packed & np.uint8(15)
        self.flat, self.there = flat, flat < 15

    def close(self, i: int, rest: np.ndarray) -> np.ndarray:
        """Those of rest that may agree with i in SHARE of the coordinates that either has."""
        agree = ((self.flat[rest] == self.flat[i]) & self.there[i]).sum(1)
        return rest[100 * agree >= SHARE * (self.there[rest] | self.there[i]).sum(1)]


_KEY = ["n_shingles", "key_a", "key_b"]


def _sets(docs: DataFrame, shingle: int, kind: str) -> DataFrame:
    """Of every document doc_id, the size and two hashes of its set, which tell sets apart without a shuffle of them;
    and, by kind, the set itself (shingles, as bytes) or its signature (sig, an array of longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets = shingle_sets(part.column("text"), shingle, known)
                raw = [s.tobytes() for s in sets]
                key_a, key_b = (pa.array([xxhash.xxh64_intdigest(r, seed) - 2**63 for r in raw], pa.int64()) for seed in (1, 2))
                if kind == "sig":
                    sigs = [signature(s) for s in sets]
                    ends = pa.array(np.cumsum([0, *map(len, sigs)]).astype(np.int32))
                    last = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sigs, np.empty(0, np.uint64)]).view(np.int64)))
                else:
                    last = pa.array(raw, pa.binary())
                columns = [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), key_a, key_b, last]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *_KEY, kind])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_shingles long, key_a long, key_b long, {kind} {'array<long>' if kind == 'sig' else 'binary'}")


def _signed(signs: DataFrame, solid: DataFrame, named: DataFrame) -> DataFrame:
    """(id, n, sig) of the classes' first rows. Only rows that may be copies of these are shuffled with their signatures."""
    copies = saved(solid.join(named.select(*_KEY, "class"), _KEY).where(F.col("row") != F.col("class")).select("row"), "dedup-copies")
    told = marked(signs.where("doc_id IS NOT NULL AND n_shingles > 0").select("row", "sig"), F.xxhash64("row"), copies, F.xxhash64("row"), ID_BITS, "copy")
    first = told.where("NOT copy").union(told.where("copy").join(copies, "row", "left_anti"))
    return first.select(F.col("row").alias("id"), F.size("sig").alias("n"), "sig")


def _needed(n):
    """Coordinates of n that agree with a class that links: all but the prefix and one more. Of a column or an array."""
    return (n * SHARE + 99) // 100 if isinstance(n, np.ndarray) else F.ceil(n * SHARE / 100).cast("int")


def _shared_tokens(signed: DataFrame, shared: DataFrame) -> DataFrame:
    """(id, token) of the coordinates that may be shared, of classes whose prefix may hold any of them; nothing is shuffled.

    Shared values go to all tasks as a map of VALUE_BITS bits. A class with more values outside the map than its prefix is long is left out.
    A full map leaves nothing out, which costs what a join of all values would.
    """
    place = F.pmod("token", F.lit(VALUE_BITS))
    words = shared.select(place.alias("place")).groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(_PAGE, np.int64)
        out[frame["word"].to_numpy() % _PAGE] = frame["bits"].to_numpy()
        return pd.DataFrame({"page": [int(frame["word"].iat[0]) // _PAGE], "bits": [out.tobytes()]})

    pages = words.groupBy(F.floor(F.col("word") / _PAGE)).applyInPandas(packed, "page int, bits binary").collect()  # VALUE_BITS / 8 bytes at most
    filled = np.zeros(VALUE_BITS >> 6, np.uint64)
    for page in pages:
        filled[page.page * _PAGE : (page.page + 1) * _PAGE] = np.frombuffer(page.bits, np.uint64)
    known = signed.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig")
            size = sig.value_lengths().to_numpy(zero_copy_only=False)
            token, row = sig.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            bit = (token % VALUE_BITS).astype(np.uint64)
            met = (known.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
            own = size - np.bincount(row[met], minlength=len(size))
            met &= (own < size - _needed(size) + 1)[row]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[row[met]]), pa.array(token[met])], ["id", "token"])

    return signed.select("id", "sig").mapInArrow(run, "id long, token long")


def prefixes(signed: DataFrame) -> DataFrame:
    """(id, prefix) of classes (id, n, sig): array<struct<count, token, hub>> of the rarest coordinates, less those it alone has.

    Order is by count, then value, for all classes alike.
    """
    tokens = signed.select(F.explode("sig").alias("token"), "id")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.min("id").alias("hub")).where("count > 1")
    shared = saved(shared, "dedup-shared")
    some = _shared_tokens(signed, shared)
    met = spread_join(some, shared, ["token"], ["id"], n="count").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "token", "hub"))).alias("met"))
    # The coordinates that a class alone has come first in its prefix.
    length = F.col("n") - _needed(F.col("n")) + 1
    prefix = F.slice("met", F.lit(1), F.greatest(length - (F.col("n") - F.size("met")), F.lit(0)))
    out = saved(met.join(signed.select("id", "n"), "id").select("id", prefix.alias("prefix")).where(F.size("prefix") > 0), "dedup-prefixes")
    dropped(shared)
    return out


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) that may agree in SHARE of their coordinates, by their sketches."""
    one, two = (sketches.select(F.col("id").alias(k), F.col("sketch").alias(f"of_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (Sketches(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES // 2)) for c in ("of_a", "of_b"))
            agree = ((x.flat == y.flat) & x.there).sum(1)
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(100 * agree >= SHARE * (x.there | y.there).sum(1))))

    return spread_join(pairs, one, ["a"], ["b"]).join(two, "b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that agree in SHARE of their coordinates, with 100 * intersection >= percent * union on the full sets."""
    one, two = (classes.select(F.col("id").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("set_a", "set_b"))
            good = [i for i, (p, q) in enumerate(zip(x, y, strict=True)) if _linked(p, q, percent)]
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    return spread_join(pairs, one, ["a"], ["b"]).join(two, "b").mapInArrow(run, "a long, b long")


def _is_star(edges: DataFrame) -> bool:
    """Whether every hi has one lo, which is no hi itself."""
    ends = edges.select(F.col("hi").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("lo", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): the smallest id reachable.

    Large-star and small-star rounds: each links every neighbour of an id to the smallest id near it, until
    all ids link to their component's smallest. A round keeps no more links than there were.
    """
    edges = saved(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "dedup-links")
    while not _is_star(edges):
        # Large star: every larger neighbour of an id goes to the smallest id near it.
        near = edges.select(F.col("hi").alias("id"), F.col("lo").alias("n")).union(edges.select(F.col("lo").alias("id"), F.col("hi").alias("n")))
        least = near.groupBy("id").agg(F.least(F.min("n"), F.col("id")).alias("m"))
        large = spread_join(near, least, ["id"], ["n"]).where("n > id").select(F.col("m").alias("lo"), F.col("n").alias("hi")).where("lo < hi").distinct()
        # Stored, as what follows names it four times: the driver keeps the plans of all rounds, and this one's would hold that join as often.
        large = saved(large, "dedup-large")
        # Small star: an id and its smaller neighbours, of which it has no more than lists, go to the smallest of them.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        down = large.join(least, "hi")
        small = down.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").union(down.select(F.col("m").alias("lo"), "hi")).distinct()
        before, edges = edges, saved(small, "dedup-round")
        dropped(before, large)
    roots = edges.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component")
    return roots.union(edges.select("lo").distinct().select(F.col("lo").alias("id"), F.col("lo").alias("component")))


def _blocks(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (id, component, own) of the pairs of blocks (token, p, q) of lists (token, id) that span components.

    A list is dealt by id hash into blocks of about BLOCK members, its largest component and the rest apart, and every two blocks meet but
    those of that component. So what a task holds at a time is bounded however long the list is, and members of a large component that
    meet few others are sent once.
    """
    labelled = lists.join(labels, "id", "left").select("token", "id", F.coalesce("component", "id").alias("component"))
    sizes = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"))
    wide = sizes.groupBy("token").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n")).where("n > main.n")
    side = lambda n: F.ceil(n / BLOCK).cast("int")
    wide = wide.select("token", F.col("main.component").alias("main"), side(F.col("main.n")).alias("mains"), side(F.col("n") - F.col("main.n")).alias("others"))
    met = spread_join(labelled, wide, ["token"], ["id"])
    inside, deal = F.col("component") == F.col("main"), F.xxhash64("id")
    met = met.withColumn("own", F.when(inside, F.pmod(deal, F.col("mains"))).otherwise(F.col("mains") + F.pmod(deal, F.col("others"))).cast("int"))
    both = met.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("mains")).otherwise(0), F.col("mains") + F.col("others") - 1)))
    return both.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "component")


def _in_groups(members: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What work makes of each (token, p, q), which a task holds one at a time."""
    group = ["token", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in group]
            # The last group may go on in the next batch.
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for start, stop in zip([0, *new[:-1]], new, strict=True) if len(new) else ():
                yield work(table.slice(start, stop - start))
            held = table.slice(new[-1] if len(new) else 0).combine_chunks().to_batches()
        if held:
            yield work(pa.Table.from_batches(held))

    return members.repartition(*group).sortWithinPartitions(*group, "id").mapInArrow(run, schema)


def _strangers(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """ids, components and blocks of a group's members, and whether it is of two blocks, whose inner pairs are left to each block's own group."""
    return *(table.column(c).to_numpy() for c in ("id", "component", "own")), table.column("p")[0] != table.column("q")[0]


def forest(table: pa.Table) -> pa.RecordBatch:
    """Pairs (a, b) of a group's members that may agree enough, as many as join all that such pairs join."""
    ids, comp, own, two = _strangers(table)
    sketches = Sketches(np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), COORDINATES // 2))
    top, found = np.arange(len(ids)), []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        able = comp[rest] != comp[i]
        if two:
            able &= own[rest] != own[i]
        for j in sketches.close(i, rest[able]):
            if top[i] != top[j]:
                found.append((i, j))
                top[top == top[j]] = top[i]
    a, b = (ids[[f[k] for f in found]] if found else np.empty(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _links(percent: int) -> Callable[[pa.Table], pa.RecordBatch]:
    """Links (a, b) of a group on full sets, but those between members that its earlier links join: fewer than members come out."""

    def work(table: pa.Table) -> pa.RecordBatch:
        ids, comp, own, two = _strangers(table)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        size = np.array([len(s) for s in sets])
        sketches = Sketches(np.stack([sketch(signature(s)) for s in sets]))
        top = comp.copy()
        found: list[tuple[int, int]] = []
        for i in range(len(ids) - 1):
            rest = np.arange(i + 1, len(ids))
            able = (top[rest] != top[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
            if two:
                able &= own[rest] != own[i]
            for j in sketches.close(i, rest[able]):
                if top[i] != top[j] and _linked(sets[i], sets[j], percent):
                    found.append((int(ids[i]), int(ids[j])))
                    top[top == top[j]] = top[i]
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return work


def sketches_of(ids: DataFrame, signed: DataFrame) -> DataFrame:
    """(id, sketch) of those classes (id, sig) that are among ids; signatures are not shuffled, only sketches of about those classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [sketch(np.asarray(sig.values.to_numpy()).view(np.uint64)).tobytes() for sig in batch.column("sig")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(told, pa.binary())], ["id", "sketch"])

    some = maybe_in(signed.select("id", "sig"), F.xxhash64("id"), ids, F.xxhash64("id"), ID_BITS)
    return some.mapInArrow(run, "id long, sketch binary").join(ids, "id", "left_semi")


def _rest(posted: DataFrame, labels: DataFrame, signed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) between components whose members meet in a list, enough of them to join all that have any."""
    blocks = saved(_blocks(posted, labels), "dedup-blocks")
    sketches = sketches_of(blocks.select("id").distinct(), signed)
    near = saved(_in_groups(blocks.join(sketches, "id"), forest, "a long, b long"), "dedup-near")
    if near.isEmpty():
        return near
    families = components(near)
    members = saved(_blocks(families.select(F.col("component").alias("token"), "id"), labels), "dedup-families")
    sets = sets_of(members.select(F.col("id").alias("class")).distinct())
    out = saved(_in_groups(members.join(sets, "id"), _links(percent), "a long, b long"), "dedup-more")
    dropped(sets)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(p) + len(q) - both)


def _labelled(ids: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """ids with column replaced by its component's label, where it has one."""
    found = labels.select(F.col("id").alias(column), F.col("component").alias("label"))
    return ids.join(found, column, "left").withColumn(column, F.coalesce("label", column)).drop("label")


def near_duplicates(docs: DataFrame, *, shingle: int = 2, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id and kept.

    Documents link if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id
    reachable, and the document with that id is kept.

    Decided cases: null and blank texts have an empty set and link with nothing (n_shingles 0, kept); texts with fewer than shingle words
    are one shingle; rows that repeat link to each other; rows that repeat a doc_id are one node of the graph, whatever their texts,
    so kept marks each of them; rows with a null doc_id link with nothing and have a null component_id and are kept; extra columns
    are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    key = _KEY
    signs = saved(_sets(docs, shingle, "sig").withColumn("row", F.monotonically_increasing_id()), "dedup-signs")
    # The result needs all but the signatures, which are dropped when nothing reads them.
    members = saved(signs.drop("sig"), "dedup-members")
    solid = members.where("doc_id IS NOT NULL AND n_shingles > 0")
    # One doc_id may stand for several classes if rows repeat it; a class is called by its first row's number.
    named = saved(solid.groupBy(*key).agg(F.min(F.struct("doc_id", "row")).alias("first")).select(*key, "first.doc_id", F.col("first.row").alias("class")), "dedup-classes")
    signed = saved(_signed(signs, solid, named), "dedup-signatures")
    dropped(signs)
    prefix = prefixes(signed)

    def sets_of(classes: DataFrame) -> DataFrame:
        """(id, shingles) of classes, hashed again from their texts."""
        ids = saved(named.join(classes, "class"), "dedup-wanted")
        some = maybe_in(docs, F.xxhash64("doc_id"), ids, F.xxhash64("doc_id"), ID_BITS)
        own = _sets(some, shingle, "shingles").join(ids, [*key, "doc_id"])
        # Rows that repeat are alike; they meet where the join has put them.
        own = own.groupBy(*key, "doc_id").agg(F.first("class").alias("id"), F.first("shingles").alias("shingles"))
        return saved(own.select("id", "shingles"), "dedup-sets")

    hubs = F.filter(F.array_distinct(F.col("prefix")["hub"]), lambda h: h != F.col("id"))
    star = saved(prefix.select(F.explode(hubs).alias("a"), F.col("id").alias("b")), "dedup-star")
    ends = sketches_of(_ends(star).withColumnRenamed("class", "id"), signed)
    star = saved(_close(star, ends), "dedup-close")
    sets = sets_of(_ends(star))
    labels = saved(components(confirmed(star, sets, percent)), "dedup-labels")
    dropped(sets)
    posted = prefix.select(F.explode("prefix").alias("t"), "id").select(F.col("t")["token"].alias("token"), "id")
    more = _rest(posted, labels, signed, sets_of, percent)
    dropped(signed, prefix)

    # What still joins components: links found late, and rows that repeat a doc_id with other texts.
    several = solid.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y").select("doc_id", "x")
    texts = solid.join(saved(several, "dedup-repeated"), "doc_id").select(F.struct(*key).alias("y"), "x").where("x <> y").distinct()
    ends = [named.select(F.struct(*key).alias(k), F.col("class").alias(c)) for k, c in (("x", "a"), ("y", "b"))]
    late = saved(more.union(texts.join(ends[0], "x").join(ends[1], "y").select("a", "b")), "dedup-late")
    tops = _labelled(named.select(*key, "doc_id", F.col("class").alias("top")), "top", labels)
    if not late.isEmpty():
        last = components(_labelled(_labelled(late, "a", labels), "b", labels)).withColumnRenamed("id", "top").withColumnRenamed("component", "last")
        tops = spread_join(tops, last, ["top"], ["doc_id"], "left").withColumn("top", F.coalesce("last", "top")).drop("last")
    tops = saved(tops, "dedup-tops")
    least = tops.groupBy("top").agg(F.min("doc_id").alias("component"))
    found = spread_join(tops, least, ["top"], ["doc_id"]).select(*key, "component")
    out = spread_join(members, found, key, ["row"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents that near_duplicates keeps, with the columns of docs; rows that repeat a doc_id go or stay together."""
    gone_id = unused("gone_id", docs)
    gone = near_duplicates(docs, shingle=shingle, percent=percent).where("NOT kept").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
