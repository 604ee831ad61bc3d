"""Stored indexes, links that are imported, and store lines to the letter."""

import pytest
from pyspark.sql import functions as F

from keyloom.plans import catalog
from keyloom.functions.text import content_hash
from keyloom.operators import facts as X
from keyloom.operators import index as I
from keyloom.operators import recall as R
from keyloom.operators import views
from keyloom.schema import KEY_FACTS, LINES, TOMB, empty_state
from keyloom.sources import readers as S
from keyloom.sources import sinks as K


@pytest.fixture(scope="module")
def state(spark):
    rows = [(i, "2020-01-01T00:00:00Z" if i % 2 else "", [f"k{i % 2}", f"K{i % 3}", "All"], f"v{i}", 0) for i in range(1, 40)]
    rows += [(i, "", [f"k{i % 2}"], f"v{i}/more", 1) for i in range(5, 10)]
    tomb = spark.createDataFrame([(4, "", "", 0), (7, "", "", 0)], TOMB)
    off = spark.createDataFrame([(6, "", "", "ALL", 0), (8, "", "", "k2", 0)], KEY_FACTS)
    return empty_state(spark)._replace(lines=spark.createDataFrame(rows, LINES), tomb=tomb, ktomb=off)


@pytest.fixture(scope="module")
def index(state, tmp_path_factory):
    return I.write_index(state, f"file://{tmp_path_factory.mktemp('index')}/i")


QUERIES = [["k0"], ["K1", "all"], ["k1", "k2", "ALL"], ["k0", "none"], ["k2", "k2"], []]


@pytest.mark.parametrize("keys", QUERIES)
@pytest.mark.parametrize("mode", ["all", "any"])
def test_lookup_is_recall(state, index, keys, mode):
    shown = views.shown(state.lines, state.tomb, state.ktomb)
    ids = lambda df: sorted(r.id for r in df.collect())
    want = ids(R.recall(shown, keys, mode))
    assert ids(I.lookup(index, keys, mode)) == want == ids(R.recall_state(state, keys, mode))
    assert ids(I.lookup(index, keys, mode, after=5, limit=4)) == [i for i in want if i > 5][:4] == ids(R.recall_state(state, keys, mode, after=5, limit=4))


def test_batch_and_tags(spark, state, index):
    queries = spark.createDataFrame(list(enumerate(QUERIES * 2)), "qid long, keys array<string>")
    postings = views.postings(views.shown(state.lines, state.tomb, state.ktomb))
    pairs = lambda df: sorted((r.qid, r.id) for r in df.collect())
    assert pairs(I.lookup_batch(index, queries)) == pairs(R.recall_batch(postings, queries))
    ids = spark.createDataFrame([(6,), (8,), (9,), (4,)], "id long")
    tags = lambda df: sorted((r.id, r.tags) for r in df.collect())
    assert tags(I.tagged(index, ids)) == tags(R.with_tags(ids, postings))


def test_key_filter_reaches_the_scan(spark, index, capsys):
    I.lookup(index, ["k0", "All"]).explain("formatted")
    assert "In(key" in capsys.readouterr().out


def tables(index):
    """All that an index holds, in order."""
    return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (index.links, index.words, index.counts, index.deleted)]


def test_edits_leave_what_a_rebuilt_index_has(spark, state, index, tmp_path):
    """Put, untag and delete, in two steps, as overlays and stored again."""
    put = [(2, "", ["k0", "K2", "All", "extra"], "v2", 0), (100, "", ["extra", "k1"], "v100", 0), (200, "2021-01-01", [], "v200", 0), (5, "", ["k1"], "v5/last", 2)]
    put_ids = [2, 100, 200, 5]
    lines = state.lines.where("id <> 2").unionByName(spark.createDataFrame(put, LINES))
    after = state._replace(lines=lines)
    some = lambda s, ids: s._replace(**{n: getattr(s, n).where(F.col("id").isin(ids)) for n in ("lines", "tomb", "ktomb")})
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    once = I.changed(index, some(after, put_ids), ids(put_ids))
    assert tables(once) == tables(I.write_index(after, f"file://{tmp_path}/a"))
    last = after._replace(
        tomb=after.tomb.where("id <> 4").unionByName(spark.createDataFrame([(9, "", "", 0), (100, "", "", 0)], TOMB)),
        ktomb=after.ktomb.unionByName(spark.createDataFrame([(i, "", "", "all", 0) for i in (2, 11, 13)], KEY_FACTS)),
    )
    edited = [4, 9, 100, 2, 11, 13]
    twice = I.changed(once, some(last, edited), ids(edited))
    rebuilt = I.write_index(last, f"file://{tmp_path}/b")
    again = I.rewritten(twice, f"file://{tmp_path}/c")
    assert tables(twice) == tables(rebuilt) == tables(again)
    assert [tuple(r) for r in I.stats(again).collect()] == [tuple(r) for r in I.stats(rebuilt).collect()]
    for keys in QUERIES:
        assert sorted(r.id for r in I.lookup(again, keys).collect()) == sorted(r.id for r in I.lookup(rebuilt, keys).collect())


def test_without_and_many_keys(spark, state, index):
    shown = views.shown(state.lines, state.tomb, state.ktomb)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(I.lookup(index, ["k0"], without=["K1", "none"])) == ids(R.set_difference(R.recall(shown, ["k0"]), R.recall(shown, ["K1"])))
    many = ["k0", *["All"] * 70, "K1"]
    assert ids(I.lookup(index, many)) == ids(R.recall(shown, ["k0", "K1", "all"])) == ids(R.recall(shown, many))
    assert ids(I.lookup(index, many, most=64)) == ids(R.recall(shown, ["k0", "all"])) == ids(R.recall(shown, many, most=64))


def test_words_move_in_place_of_ids(spark):
    """A busy key's postings are a row for 64 ids."""
    ids = spark.range(1, 10_001).withColumn("key", F.lit("hot"))
    words = I.words_of(ids, "key")
    assert words.count() == 157 and sorted(r.id for r in I.ids_of(words, "key").collect()) == list(range(1, 10_001))


def test_links_are_imported_once(spark, state):
    def told(rows):
        frame = spark.createDataFrame(rows, "seq long, hash_of string, value string")
        return frame.select("seq", F.lit("M").alias("verb"), content_hash(F.col("hash_of")).alias("hash"), "value")

    facts = told([(1, "v5", "new"), (2, "v5/more", "newer"), (3, "v6", "new"), (4, "v4", "dead"), (5, "nowhere", "x"), (6, "v5", "v9"), (7, "v5", "v4"), (8, "v5", "")])
    once = X.import_links(state.lines, state.tomb, facts)
    added = once.join(state.lines.select("value"), "value", "left_anti").orderBy("ord").collect()
    assert [(r.id, r.value, r["keys"], r.ts) for r in added] == [(5, "new", ["k1", "K2", "All"], ""), (5, "newer", ["k1", "K2", "All"], "")]
    assert X.import_links(once, state.tomb, facts).count() == once.count() == state.lines.count() + 2


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("1|2020-01-01|a b|v|w", (1, "2020-01-01", ["a", "b"], "v|w")),
        ("1|2020-01-01|k", (1, "2020-01-01", ["k"], "")),
        ("1|2020-01-01", (1, "2020-01-01", [], "")),
        ("1|a b|v|w", (1, "", ["a", "b"], "v|w")),
        ("1|a b", (1, "", ["a", "b"], "")),
        ("3||k|v", (3, "", [], "k|v")),
        ("1|2020-01-01T10:00:00Z|k|v\r\r", (1, "2020-01-01T10:00:00Z", ["k"], "v")),
        ("  +7x|k|v", (7, "", ["k"], "v")),
        ("0|k|v", None),
        ("-1|k|v", None),
        ("no bar", None),
        ("", None),
    ],
)
def test_store_lines(spark, line, want):
    good, bad = S.parse_lines(spark.createDataFrame([(line, 0)], "line string, ord long"))
    got = [(r.id, r.ts, r["keys"], r.value) for r in good.collect()]
    assert got == ([want] if want else []) and bad.count() == (0 if want else 1)


def test_undated_records_survive_a_round_trip(spark, tmp_path):
    rows = [(1, "", ["a"], "x|y", 0), (2, "2020-01-01", [], "v", 0), (3, "", [], "w", 0)]
    lines = spark.createDataFrame(rows, LINES)
    K.write_store(lines, f"file://{tmp_path}/s")
    back = S.parse_lines(S.read_text(spark, f"file://{tmp_path}/s"))[0].drop("ord")
    assert sorted(map(tuple, back.collect())) == sorted(r[:4] for r in rows)


def test_batches_count_and_meet_by_words_of_bits(spark):
    for name in ("recall_batch_or", "recall_batch_and"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "ekeys" not in plan and (name == "recall_batch_and" or "sequence(" not in plan)
