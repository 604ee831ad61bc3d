"""Sharding: the matrix against plain permutations, and whole results against brute-force counts."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import sharding
from keyloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def whole(rows, n, shards):
    """Each shard has its size, and slots from 0 without gaps."""
    by = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(shards)}
    assert len(rows) == n and all(r.shard in by for r in rows)
    assert all(slots == list(range(len(slots))) for slots in by.values())
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1


def test_documents(spark):
    docs = {r.doc_id: r.text or "" for r in documents(spark, SF).collect()}
    rows = sharding.op11_sharding(spark, SF).collect()
    whole(rows, len(docs), 24)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    assert sorted(map(str, rows)) == sorted(map(str, sharding.op11_sharding(spark, SF).collect()))
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] != sorted(docs)


def test_matrix_has_its_sums_and_the_law_of_a_permutation():
    counts, room = np.array([3, 0, 2, 1]), np.array([2, 2, 1, 1])
    seen, plain = Counter(), Counter()
    rng = np.random.default_rng(0)
    parts = np.repeat(np.arange(4), counts)
    trials = 20_000
    for t in range(trials):
        m = np.array([sharding.matrix_row(t, counts, room, p) for p in range(4)])
        assert (m.sum(1) == counts).all() and (m.sum(0) == room).all()
        seen[m.tobytes()] += 1
        cells = rng.permutation(np.repeat(np.arange(4), room))
        other = np.zeros((4, 4), np.int64)
        np.add.at(other, (parts, cells), 1)
        plain[other.tobytes()] += 1
    keys = set(seen) | set(plain)
    chi = sum((seen[k] - plain[k]) ** 2 / (seen[k] + plain[k]) for k in keys)
    assert chi < len(keys) + 5 * (2 * len(keys)) ** 0.5


@pytest.mark.parametrize("good, bad, take", [(30, 50, 20), (5, 200, 60), (1, 1, 1), (7, 3, 10), (40, 9, 0)])
def test_large_draws_follow_the_same_law(monkeypatch, good, bad, take):
    rng = np.random.default_rng(1)
    known = rng.hypergeometric(good, bad, take, 20_000)
    monkeypatch.setattr(sharding, "LARGE", 0)
    own = np.array([sharding.hypergeometric(rng, good, bad, take) for _ in range(20_000)])
    top = max(known.max(), own.max()) + 1
    a, b = np.bincount(known, minlength=top), np.bincount(own, minlength=top)
    some = a + b > 0
    assert ((a - b)[some] ** 2 / (a + b)[some]).sum() < some.sum() + 5 * (2 * some.sum()) ** 0.5 + 5


def test_populations_beyond_numpy():
    counts, room = np.array([4_000_000_000, 1, 5_999_999_999]), np.array([7_000_000_000, 3_000_000_000])
    m = np.array([sharding.matrix_row(3, counts, room, p) for p in range(3)])
    assert (m.sum(1) == counts).all() and (m.sum(0) == room).all() and (m >= 0).all()
    assert abs(m[0, 0] - 2_800_000_000) < 10 * (4e9 * 0.7 * 0.3 * 0.6) ** 0.5


def test_every_row_may_go_everywhere(spark, tmp_path):
    """Over many seeds: places of a row are uniform, and neighbours part."""
    spark.range(60, numPartitions=4).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    first, together, seeds = Counter(), 0, 40
    for seed in range(seeds):
        got = {r.id: (r.shard, r.slot) for r in sharding.shuffled(rows, 3, seed=seed, cell_rows=7).collect()}
        first.update([got[0]])
        together += sum(got[i][0] == got[i + 1][0] for i in range(59))
    assert len(first) > 20 and max(first.values()) < 8
    assert abs(together / (59 * seeds) - 19 / 59) < 0.05


def test_cells_smaller_than_shards(spark, tmp_path):
    spark.range(1000, numPartitions=5).write.parquet(str(tmp_path / "rows"))
    whole(sharding.shuffled(spark.read.parquet(str(tmp_path / "rows")), 7, cell_rows=16).collect(), 1000, 7)


def test_nulls_repeats_clashing_columns_and_empty_tables(spark, tmp_path):
    data = [(None, None, 1, "x")] * 3 + [(1, "", 2, None), (1, "a" * 300_000, 3, "y")]
    frame = spark.createDataFrame(data, "doc_id long, text string, SHARD int, `cell_.block_` string").coalesce(1)
    frame.write.parquet(str(tmp_path / "rows"))
    rows = sharding.shuffled(spark.read.parquet(str(tmp_path / "rows")), 3)
    assert rows.columns == ["doc_id", "text", "cell_.block_", "shard", "slot"]
    got = rows.collect()
    whole(got, 5, 3)
    assert sorted((len(r.text or ""), r["cell_.block_"] or "") for r in got) == [(0, ""), (0, "x"), (0, "x"), (0, "x"), (300_000, "y")]
    whole(sharding.shuffled(rows.limit(0), 3).collect(), 0, 3)
    assert sharding.shuffled(spark.createDataFrame([], "doc_id long"), 3).count() == 0


def test_rows_that_change_between_the_passes_are_refused(spark):
    """Partitions of another size than counted are an error, not a loss."""
    some = F.udf(lambda: os.urandom(1)[0] < 128, "boolean").asNondeterministic()
    with pytest.raises(Exception, match="when it was counted"):
        sharding.shuffled(spark.range(1000, numPartitions=2).where(some()), 3).collect()


def test_written_shards_keep_their_order(spark, tmp_path):
    spark.range(500, numPartitions=3).write.parquet(str(tmp_path / "rows"))
    dealt = sharding.shuffled(spark.read.parquet(str(tmp_path / "rows")), 4, cell_rows=50)
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    whole(back.collect(), 500, 4)
    one = back.inputFiles()[0]
    slots = [r.slot for r in spark.read.parquet(one).collect()]
    assert slots == sorted(slots)
