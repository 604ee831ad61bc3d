"""Conversation prefix trie: member intervals from range minima over sorted common-prefix lengths.

Conversations are sorted by their turns' digests, range by range. A row's longest common prefix (LCP) with the row before it tells which of its
prefixes are new; a sparse table of minima lets each of these binary-search how far it reaches to the right and its parent to the left, all at once
and without a stack. Prefixes that touch an end of their range are searched once more, by the same code, among the first and last rows of all ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import fresh
from .common import saved

#: Bytes of a turn's digest in a path.
DIGEST = 16
#: Ids of a prefix that crosses ranges travel as text, so many to a row.
PIECE_IDS = 4096
#: What a range tells: complete nodes, its part of nodes that touch an end, and ids that end there.
_NODE, _PART, _IDS = 0, 1, 2
_TOLD = "kind int, part int, entry int, conv_id long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, digest binary, piece int, ids string"
_COLUMNS = [c.split()[0] for c in _TOLD.split(", ")]
_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]) for c in _TOLD.split(", ")])
_NONE = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (turn, digest, bytes) in order of turn, null first.

    Null roles and texts are empty. Rows of equal turn follow by their digest, so rows that repeat stay neighbours. Rows without a conv_id are in no
    conversation. Only digests and sizes are gathered, some 60 bytes a turn, in one row for a conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.sha2(told.cast("binary"), 256), 1, 2 * DIGEST)
    one = F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id IS NOT NULL").select("conv_id", one.alias("one")).groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def paths(of: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of (conv_id, turns): the digests in a row, and the bytes of each text. Paths sort as their sequences of turns do."""
    digests = F.transform("turns", lambda x: x["digest"])
    return of.select("conv_id", F.unhex(F.array_join(digests, "")).alias("path"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"))


def rebuilt(of: DataFrame, group: int, modulus: int) -> DataFrame:
    """Conversations (conv_id, turns) that begin with their base's first turns, which is c - c % group; their own turns follow after as many."""
    n = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus)).cast("int")
    heads = of.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, modulus).alias("head"))
    rows = of.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("n", n).join(heads, "base", "left")
    head = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", F.lit(1), F.col("n")))
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("n") + 1, F.size("turns"))).alias("turns"))


def common_prefixes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """LCP of each row with the row before it; -1 for the first. Row i is flat[offsets[i]:offsets[i + 1]]."""
    lens = np.diff(offsets)
    least = np.minimum(lens[1:], lens[:-1])
    row = np.repeat(np.arange(1, len(lens)), least)
    at = np.arange(len(row)) - np.repeat(np.cumsum(least) - least, least)
    other = np.flatnonzero((flat[offsets[row - 1] + at] != flat[offsets[row] + at]).any(1))
    out = np.r_[-1, least]
    first, place = np.unique(row[other], return_index=True)
    out[first] = at[other[place]]
    return out


class Minima:
    """A sparse table: the minimum of any run of values in two looks."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        step = 1
        while 2 * step <= self.n:
            below = self.levels[-1]
            self.levels.append(np.minimum(below[:-step], below[step:]))
            step *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], for each pair."""
        out = np.empty(len(first), self.levels[0].dtype)
        size = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        for k in np.unique(size):
            some = size == k
            out[some] = np.minimum(self.levels[k][first[some]], self.levels[k][last[some] - (1 << int(k)) + 1])
        return out

    def right(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The last row that shares depth turns with row, where values are LCPs."""
        at = row.copy()
        for k in reversed(range(len(self.levels))):
            level, step = self.levels[k], 1 << k
            at += step * ((at + step < self.n) & (level[np.minimum(at + 1, len(level) - 1)] >= depth))
        return at

    def left(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first row that shares depth turns with row."""
        at = row.copy()
        for k in reversed(range(len(self.levels))):
            level, step = self.levels[k], 1 << k
            at -= step * ((at - step >= 0) & (level[np.clip(at - step + 1, 0, len(level) - 1)] >= depth))
        return at


class Prefixes(NamedTuple):
    """The distinct prefixes of sorted rows, in preorder: the row that each begins at, its depth, last row, parent (-1: none) and the end of its subtree."""

    row: np.ndarray
    depth: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    end: np.ndarray
    starts: np.ndarray
    lcp: np.ndarray

    @classmethod
    def of(cls, lcp: np.ndarray, lens: np.ndarray) -> Prefixes:
        """A row's new prefixes are those longer than its LCP. Each finds its last row on its own; the parent of the first of them begins where its LCP does."""
        table, new = Minima(lcp), lens - lcp
        ends = np.cumsum(new)
        starts = ends - new
        row = np.repeat(np.arange(len(lens)), new)
        depth = lcp[row] + 1 + np.arange(len(row)) - starts[row]
        last = table.right(row, depth)
        parent = np.arange(len(row)) - 1
        some = np.flatnonzero((depth == lcp[row] + 1) & (depth > 0))
        parent[some] = _place(table.left(row[some], depth[some] - 1), depth[some] - 1, starts, lcp)
        return cls(row, depth, last, parent, ends[last], starts, lcp)

    def place(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Numbers of the prefixes of rows at depths."""
        return _place(Minima(self.lcp).left(row, depth), depth, self.starts, self.lcp)

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each subtree, its top included."""
        sums = np.r_[0, np.cumsum(values)]
        return sums[self.end] - sums[:-1]


def _place(first: np.ndarray, depth: np.ndarray, starts: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    return starts[first] + depth - lcp[first] - 1


def _batch(kind: int, part: int, n: int, **columns) -> pa.RecordBatch:
    return _row_batch(n, {"kind": np.full(n, kind, np.int32), "part": np.full(n, part, np.int32)} | columns)


def _row_batch(n: int, given: dict) -> pa.RecordBatch:
    """A batch of _TOLD; columns that are not given are null."""
    filled = lambda f: given[f.name] if isinstance(given[f.name], pa.Array) else pa.array(given[f.name], f.type)
    return pa.RecordBatch.from_arrays([filled(f) if f.name in given else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: its complete nodes, and its part of those that touch its first or last row."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    part = TaskContext.get().partitionId()
    ids = rows["conv_id"].to_numpy()
    path = rows["path"].cast(pa.large_binary()).combine_chunks()
    offsets = np.frombuffer(path.buffers()[1], np.int64)[path.offset : path.offset + len(path) + 1]
    data = np.frombuffer(path.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    flat, offsets = data.copy().view(np.uint64).reshape(-1, 2), (offsets - offsets[0]) // DIGEST
    sizes = rows["sizes"].combine_chunks().flatten().to_numpy()

    tree = Prefixes.of(common_prefixes(flat, offsets), np.diff(offsets))
    n = tree.last - tree.row + 1
    turn = offsets[tree.row] + tree.depth - 1  # of a prefix's last turn; the root has none
    size = np.where(tree.depth > 0, np.r_[sizes, 0][turn], 0)
    inner = (tree.row > 0) & (tree.last < len(ids) - 1)
    children = np.bincount(tree.parent[inner], minlength=len(n))  # whoever touches no end has a parent
    leaves = tree.below((inner & (children == 0)).astype(np.int64))
    spared = tree.below(np.where(inner, (n - 1) * size, 0))
    least = Minima(ids).of(tree.row, tree.last)

    # Rows without new prefixes equal the row before them; a prefix's members that end there are the run of its own row.
    firsts = np.flatnonzero(np.diff(np.r_[tree.starts, len(n)]))
    runs = np.diff(np.r_[firsts, len(ids)])
    whole = np.r_[tree.starts, len(n)][firsts + 1] - 1
    hashes = np.full(len(n), _NONE, object)
    text = pa.array(ids).cast(pa.string()).to_pylist()
    entry = np.cumsum(~inner) - 1
    for node, first, count in zip(whole, firsts, runs, strict=True):
        if inner[node]:
            hashes[node] = hashlib.sha256(",".join(text[first : first + count]).encode()).hexdigest()
        else:
            pieces = [",".join(text[i : min(i + PIECE_IDS, first + count)]) for i in range(first, first + count, PIECE_IDS)]
            yield _batch(_IDS, part, len(pieces), entry=np.full(len(pieces), entry[node], np.int32), piece=np.arange(len(pieces), dtype=np.int32), ids=pieces)

    k = np.flatnonzero(inner)
    up = tree.parent[k]
    known = inner[up]
    yield _batch(
        _NODE, part, len(k), entry=pa.array(entry[up].astype(np.int32), mask=known), parent=pa.array(least[up], mask=~known), conv_id=least[k], depth=tree.depth[k],
        n_convs=n[k], n_children=children[k], n_leaves=leaves[k], saved_tokens=spared[k], ids=hashes[k].tolist(),
    )
    k = np.flatnonzero(~inner)
    digests = [flat[turn[i]].tobytes() if tree.depth[i] else b"" for i in k]
    yield _batch(
        _PART, part, len(k), entry=entry[k].astype(np.int32), conv_id=least[k], depth=tree.depth[k], n_convs=n[k],
        n_children=children[k], n_leaves=leaves[k], saved_tokens=spared[k], bytes=size[k], digest=digests,
    )


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that touch ends of ranges, from the prefixes of each range's first and last row: a row for each part, of which a node's first holds its figures.

    entry and part are the part's own; piece is the node's number, kind is _NODE for a node's first part.
    """
    rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if rows is None:
        return
    rows = rows.sort_by([("part", "ascending"), ("entry", "ascending")])
    col = {c: rows[c].to_numpy() for c in ("part", "entry", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "bytes")}
    depth, digests = col["depth"], rows["digest"].to_pylist()
    # A range's first row has the depths from 0 on without a gap, its last row goes on from their common prefix.
    heads = np.flatnonzero(np.r_[True, col["part"][1:] != col["part"][:-1]])
    flat, offsets, row = [], [0], np.empty(len(depth), np.int64)
    for p, (lo, hi) in enumerate(zip(heads, np.r_[heads[1:], len(depth)], strict=True)):
        n = int(np.argmin(np.r_[np.diff(depth[lo:hi]) == 1, False])) + 1
        tail = lo + n
        # Without a jump in depth the last row is either the first one again or goes on from it.
        shared = depth[tail] - 1 if tail < hi else depth[tail - 1]
        first = digests[lo + 1 : tail]
        last = first[:shared] + digests[tail:hi]
        flat += first + last
        offsets += [offsets[-1] + len(first), offsets[-1] + len(first) + len(last)]
        row[lo:tail], row[tail:hi] = 2 * p, 2 * p + 1
    offsets = np.array(offsets)
    tree = Prefixes.of(common_prefixes(np.frombuffer(b"".join(flat), np.uint64).reshape(-1, 2), offsets), np.diff(offsets))

    node, nodes = tree.place(row, depth), len(tree.row)

    def total(name: str) -> np.ndarray:
        out = np.zeros(nodes, np.int64)
        np.add.at(out, node, col[name])
        return out

    n, least, size = total("n_convs"), np.full(nodes, np.iinfo(np.int64).max), np.zeros(nodes, np.int64)
    np.minimum.at(least, node, col["conv_id"])
    size[node] = col["bytes"]
    children = total("n_children") + np.bincount(tree.parent[tree.parent >= 0], minlength=nodes)
    leaves = total("n_leaves") + tree.below((children == 0).astype(np.int64))
    spared = total("saved_tokens") + tree.below((n - 1) * size)
    first = np.zeros(len(node), bool)
    first[np.unique(node, return_index=True)[1]] = True
    up = tree.parent[node]
    yield _row_batch(len(node), {
        "kind": np.where(first, _NODE, _PART).astype(np.int32), "part": col["part"], "entry": col["entry"], "conv_id": least[node], "depth": depth,
        "parent": pa.array(least[np.maximum(up, 0)], mask=up < 0), "n_convs": n[node], "n_children": children[node], "n_leaves": leaves[node],
        "saved_tokens": spared[node], "piece": node.astype(np.int32),
    })


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces of ids, which stream by in order."""
    names = ["node", "ends_sha256"]
    node, digest = None, None
    for batch in batches:
        done: list[tuple[int, str]] = []
        for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if own != node:
                if digest is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int32()), pa.array([x[1] for x in done], pa.string())], names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([digest.hexdigest()], pa.string())], names)


def prefix_trie(of: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the paths in (conv_id, path, sizes); the columns are those of op13_prefix_trie.

    Rows are ranged by (path, conv_id), so that copies of one conversation are dealt over ranges too. A range is held by one task: its rows are bounded by
    the partitions that Spark makes. Nodes inside a range are complete there. Of all others each range tells its part; these, one row for a prefix of its
    first and last row, meet in one task, so that what meets there grows with the number of ranges and not with their rows. The ids that end
    at such a node are hashed in order as they stream through one task in pieces, as SHA-256 is sequential.

    Decided cases: a conversation without turns ends at the root; repeated paths are members of the same nodes; an empty table gives no rows; conv_id must
    be unique and not null.
    """
    spark = of.sparkSession
    path = fresh(spark, "trie")
    sorted_ = of.select("conv_id", "path", "sizes").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    sorted_.mapInArrow(_range_nodes, _TOLD).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    told = spark.read.schema(_TOLD).parquet(path)
    of_kind = lambda k: told.where(F.col("kind") == k)

    across = saved(of_kind(_PART).select(*_COLUMNS).coalesce(1).mapInArrow(_across, _TOLD), "trie-across")
    its = across.select("part", "entry", F.col("piece").alias("node"), F.col("conv_id").alias("its_id"))
    pieces = of_kind(_IDS).select("part", "entry", "piece", "ids").join(its, ["part", "entry"]).select("node", "part", "piece", "ids")
    hashes = pieces.repartition("node").sortWithinPartitions("node", "part", "piece").mapInArrow(_hashed, "node int, ends_sha256 string")

    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    inside = of_kind(_NODE).join(its.drop("node"), ["part", "entry"], "left")
    inside = inside.select("conv_id", "depth", F.coalesce("parent", "its_id").alias("parent_conv_id"), *figures, F.col("ids").alias("ends_sha256"))
    crossing = across.where(F.col("kind") == _NODE).join(hashes, F.col("piece") == F.col("node"), "left")
    crossing = crossing.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), *figures, F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))
    return inside.unionByName(crossing)


def conversation_trie(rows: DataFrame, change=None) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text); change may rebuild (conv_id, turns) first. Other columns are left out, whatever their names."""
    own = saved(turns(rows), "trie-turns")
    return prefix_trie(paths(own if change is None else change(own)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_trie(rows, lambda own: rebuilt(own, 5, 9))


def _sql_crc(text: str) -> str:
    byte = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    chars = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda c, b: {byte}), 4294967295)"


OP13_SQL = f"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, substr(sha256(strlen(role) || ':' || role || text), 1, 32)) AS turns FROM given GROUP BY conv_id
), lengths AS (
  SELECT *, conv_id - conv_id % 5 AS base, ({_sql_crc("conv_id::VARCHAR")}) % 9 AS h FROM own
), rebuilt AS (
  SELECT l.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN l.turns[1:0] ELSE b.turns[1:l.h] END, l.turns[l.h + 1:]) AS turns
  FROM lengths l LEFT JOIN own b ON b.conv_id = l.base
), members AS (
  SELECT conv_id, len(turns) AS n, d, turns[1:d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(path[d].text), 0) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY path, d
), children AS (
  SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), counted AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (path)
), above AS (
  SELECT path[1:e] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.n_leaves::BIGINT AS n_leaves, a.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN above a USING (path) LEFT JOIN nodes p ON c.d > 0 AND p.path = c.path[1:c.d - 1]
"""
