"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from keyloom.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(convs):
    """convs: {conv_id: [(role, text), ...]}"""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, spared = defaultdict(int), defaultdict(int)
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            spared[p[:d]] += (len(ms) - 1) * (len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), kids[p], leaves[p], spared[p], sha(p)) for p, ms in members.items())


def told(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in df.collect())


def own_turns(rows):
    """Without ties in turn."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in by.items()}


def many(rng, n, words=3, longest=6):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice("abcdefg"[:words]) * rng.randrange(1, 3)))
    return rows


@pytest.mark.parametrize("seed, words, partitions", [(0, 1, 2), (1, 2, 7), (2, 3, 1), (3, 2, 40)])
def test_any_ranges_give_the_plain_trie(spark, seed, words, partitions):
    """Few words, so that prefixes and whole conversations cross ranges."""
    rows = many(random.Random(seed), 150, words)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = told(P.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(own_turns(rows))


def test_rebuilt_conversations(spark):
    rng = random.Random(5)
    rows = [r for r in many(rng, 60, 2, 12) if r[0] % 7 != 5 or r[0] % 5]
    own = own_turns(rows)
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not v for v in made.values())
    assert told(P.conversation_trie(spark.createDataFrame(rows, SCHEMA), lambda own: P.rebuilt(own, 5, 9))) == plain_trie(made)


def test_one_conversation_held_by_most(spark, monkeypatch):
    """Its ids cross ranges and go in pieces of a few."""
    rows = [(c, t, "user", "same" if c % 3 else f"other {c % 6}") for c in range(900) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert told(P.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == plain_trie(own_turns(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_of_ids_hash_as_one(spark):
    rows = [(c, 0, "user", "x") for c in range(3 * P.PIECE_IDS)]
    got = told(P.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_trie(own_turns(rows))


def test_nulls_empty_texts_long_texts_repeats_and_other_columns(spark):
    rows = [(1, None, None, "first"), (1, 0, "user", None), (1, 5, "", "é" * 50_000), (2, 0, None, "first"), (2, 1, "user", ""), (None, 0, "user", "lost"), (-7, 3, "a", "b")]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", path int, sizes string")
    assert told(P.conversation_trie(frame)) == plain_trie(own_turns(rows))
    # Roles and texts that read alike in a row are told apart.
    split = [(1, 0, "a", "bc"), (2, 0, "ab", "c")]
    assert len(told(P.conversation_trie(spark.createDataFrame(split, SCHEMA)))) == 3
    # Rows of one turn are in one order, whatever order they come in.
    ties = [(1, 0, "u", "x"), (1, 0, "u", "y"), (2, 0, "u", "y"), (2, 0, "u", "x"), (3, 1, "u", "z"), (3, 1, "u", "z")]
    got = told(P.conversation_trie(spark.createDataFrame(ties, SCHEMA)))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 0, 3), (1, 1, 2), (1, 2, 2), (3, 1, 1), (3, 2, 1)]


def test_empty_table(spark):
    assert P.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minima_and_searches():
    rng = np.random.default_rng(0)
    values = np.r_[-1, rng.integers(0, 5, 200)]
    table = P.Minima(values)
    first = rng.integers(0, 201, 500)
    last = np.minimum(first + rng.integers(0, 201, 500), 200)
    assert table.of(first, last).tolist() == [values[a : b + 1].min() for a, b in zip(first, last)]
    depth = rng.integers(0, 6, 500)
    for i, d, right, left in zip(first, depth, table.right(first, depth), table.left(first, depth)):
        assert right == next((j - 1 for j in range(i + 1, 201) if values[j] < d), 200)
        assert left == next((j for j in range(i, 0, -1) if values[j] < d), 0)
