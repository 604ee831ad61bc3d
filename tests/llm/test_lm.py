import numpy as np
import pytest

from keyloom.llm import lm_scoring as L

from . import brute_lm


def check(rows, docs):
    want = brute_lm.score(docs)
    assert len(rows) == len(docs)
    for r in rows:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9, abs=1e-9)
        assert abs(r.score - w[5]) <= 2 * L.STEP * r.n_tokens + 1e-3


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(L.op7_lm_scoring(spark, sf).collect(), docs)


def test_small_batches_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(L, "UNIT_TOKENS", 4)
    monkeypatch.setattr(L, "ROOT", 1)
    docs = {i: t for i, t in enumerate(["a b a", None, "", "A  B\tc", "é É", "x" * 50_000, "the " * 3000, "a b", "new words only", "c\x0bd\x0ce", "z\x1cy"] * 3)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(L.score_texts(frame).collect(), docs)


def test_nulls_repeats_and_empty(spark):
    frame = spark.createDataFrame([(None, "a b"), (0, "a b"), (0, "a b"), (0, "c")], "doc_id long, text string")
    rows = L.score_texts(frame).collect()
    assert sorted(r.n_tokens for r in rows) == [2, 3, 3, 3] and len({r.score for r in rows}) == 2
    assert sum(r.doc_id is None for r in rows) == 1
    assert L.score_texts(frame.where("false")).count() == 0


SEQUENCES = ([], [0], [5], [5, 5, 5], np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, np.uint64)), np.arange(300), np.sort(np.random.default_rng(2).integers(0, 40, 500)), [2**64 - 1], [0, 2**64 - 2])


def mapped(tmp_path, values):
    path = str(tmp_path / "level")
    with open(path, "wb") as f:
        f.write(b"head")
        place = L.EliasFano.of(np.array(values, np.uint64)).write(f)
    return L.EliasFano.mapped(path, place)


@pytest.mark.parametrize("values", SEQUENCES, ids=range(len(SEQUENCES)))
def test_elias_fano_finds_what_is_there(tmp_path, values):
    values = np.array(values, np.uint64)
    level = mapped(tmp_path, values)
    got = level.find(values, 7)
    assert (values[got] == values).all() and (got >= 0).all()
    asked = np.unique(np.r_[values + np.uint64(1), values - np.uint64(1), np.random.default_rng(3).integers(0, 2**63, 200, np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    there = np.isin(asked, values)
    got = level.find(asked, 11)
    assert ((got >= 0) == there).all() and (values[got[there]] == asked[there]).all()


class Counted:
    """An array that counts the bytes taken from it."""

    def __init__(self, held):
        self.held, self.taken = held, 0

    def __getitem__(self, i):
        got = self.held[i]
        self.taken += np.asarray(got).nbytes
        return got


def test_a_probe_touches_few_bytes(tmp_path):
    values = np.sort(np.random.default_rng(4).integers(0, 2**50, 300_000, np.uint64))
    level = mapped(tmp_path, values)
    level.low, level.high = Counted(level.low), Counted(level.high)
    assert level.find(values[1234:1235])[0] >= 0 and level.find(np.array([7], np.uint64))[0] == -1
    assert level.low.taken + level.high.taken < 1000


def test_rows_grow_with_the_tokens(spark, monkeypatch):
    """A batch and a shard grow with the root of the tokens, so four times the text is about four times the rows, not sixteen times."""
    monkeypatch.setattr(L, "UNIT_TOKENS", 1)
    monkeypatch.setattr(L, "LEAST_SHARDS", 1)
    rows = []
    frequent = spark.sparkContext.broadcast((np.zeros(1, np.uint64),))
    for n in (250, 1000):
        frame = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + k * k) % 5000}" for k in range(40)), False) for i in range(n)], "doc_id long, text string, held_out boolean").coalesce(1)
        unit = L.ROOT * int((41 * n) ** 0.5)
        rows.append(L._sent(frame, frequent, 1 + 41 * n // unit, unit).count())
    assert rows[1] < 6 * rows[0]
