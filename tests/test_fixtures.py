"""Small indexes with results known beforehand."""

import pytest
from pyspark.sql import functions as F

from keyloom.functions import text as X
from keyloom.operators import browse as B
from keyloom.operators import recall as R
from keyloom.operators import upsert as U
from keyloom.operators import views
from keyloom.schema import KEY_FACTS, LINES, TOMB
from keyloom.sources import readers as S
from keyloom.sources.sinks import dump_line, store_line

SIX = [
    (1, "linux samba config network", "/etc/samba/smb.conf"),
    (2, "linux nfs export network", "/etc/exports"),
    (3, "c ansi build make", "https://www.gnu.org/software/make/"),
    (4, "c ansi compression kolmogorov", "https://en.wikipedia.org/wiki/Kolmogorov_complexity"),
    (5, "memory archive longevity", "Plain UTF-8 text outlives every binary format."),
    (6, "memory archive sdcard", "Soft-link the INDEX dir into the app."),
]


def lines(spark, rows):
    return spark.createDataFrame([(r[0], r[3] if len(r) > 3 else "", r[1].split(), r[2], 0) for r in rows], LINES)


def shown(spark, rows, tomb=(), ktomb=()):
    t = spark.createDataFrame([(i, "", "", 0) for i in tomb], TOMB)
    k = spark.createDataFrame([(i, "", "", key, 0) for i, key in ktomb], KEY_FACTS)
    return views.shown(lines(spark, rows), t, k)


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(
    ("keys", "mode", "want"),
    [
        (["c", "ansi"], "all", [3, 4]),
        (["linux", "network"], "all", [1, 2]),
        (["samba"], "all", [1]),
        (["memory", "archive"], "all", [5, 6]),
        (["linux", "nfs"], "all", [2]),
        (["samba", "nfs"], "any", [1, 2]),
        (["longevity", "sdcard"], "any", [5, 6]),
        (["nonexistent"], "all", []),
        (["linux", "nonexistent"], "all", []),
        (["nonexistent", "NFS"], "any", [2]),
        ([], "all", []),
        ([""], "any", []),
    ],
)
def test_recall(spark, keys, mode, want):
    frame = shown(spark, SIX)
    assert ids(R.recall(frame, keys, mode)) == want
    if keys:
        assert ids(R.recall_postings(views.postings(frame), keys, mode)) == want


def test_recall_of_many_keys(spark):
    rows = [(1, "one two three four five six", "all-six"), (2, "one two three four five", "only-five"), (3, "six seven", "six-and-seven")]
    frame = shown(spark, rows)
    six = ["one", "two", "three", "four", "five", "six"]
    assert ids(R.recall(frame, six)) == [1]
    assert ids(R.recall(frame, six[:5])) == [1, 2]
    assert ids(R.recall(frame, [*six, "absent"])) == []
    assert ids(R.recall(frame, ["one", "four", "six", "seven", "nine", "ten"], "any")) == [1, 2, 3]


def test_deleted_and_detached_stay_out(spark):
    frame = shown(spark, SIX, tomb=[1], ktomb=[(3, "ANSI")])
    assert ids(R.recall(frame, ["linux"])) == [2]
    assert ids(R.recall(frame, ["ansi"])) == [4]
    assert ids(R.recall(frame, ["build"])) == [3]


def test_pages(spark):
    frame = shown(spark, [(i, "k", f"v{i}") for i in range(1, 6)])
    pages = [ids(R.recall(frame, ["k"], after=a, limit=2)) for a in (0, 2, 4, 5)]
    assert pages == [[1, 2], [3, 4], [5], []]
    assert ids(R.recall(frame, ["k"], limit=0)) == [1, 2, 3, 4, 5]


def test_tags_and_their_pages(spark):
    p = views.postings(shown(spark, SIX))
    every = [(r.n, r.key) for r in B.tags(p).orderBy(F.desc("n"), "key").collect()]
    assert len(every) == 16 and every[0] == (2, "ansi") and sum(n == 2 for n, _ in every) == 6
    got, after = [], None
    while page := [(r.n, r.key) for r in B.tags(p, after, 5).collect()]:
        got += page
        after = page[-1]
    assert got == every


@pytest.mark.parametrize(
    ("key", "want"),
    [("Linux", "linux"), ("C ANSI", "c_ansi"), ("a\tb", "a_b"), ("a|b", "a_b"), ("a/b", "a_b"), ("a\\b", "a_b"), (".x", "_x"), ("É.", "É."), ("\x7f", "_"), ("", ""), (None, None), ("é" * 300, "é" * 255)],
)
def test_key_encode(spark, key, want):
    assert spark.createDataFrame([(key,)], "k string").select(X.key_encode(F.col("k"))).first()[0] == want


def test_key_prefix_and_hash(spark):
    row = spark.createDataFrame([("linux", "c", "éa", "a", "/etc/exports", "")], "a string, b string, c string, d string, e string, f string")
    got = row.select(*[X.key_prefix(F.col(c)) for c in "abc"], *[X.content_hash(F.col(c)) for c in "def"]).first()
    assert tuple(got) == ("li", "c", "é", "44bd8ad473cd9906", "31d7499817d5d452", "14650fb0739d0383")


TIMES = [(1, "k", "old", "2020-01-01T10:00:00"), (2, "k", "mid", "2022-06-15T12:00:00"), (3, "k", "new", "2024-12-31T23:00:00"), (4, "k", "undated", "")]


@pytest.mark.parametrize(
    ("options", "want"),
    [
        ({}, [4, 3, 2, 1]),
        ({"first": "2022-01-01"}, [3, 2]),
        ({"last": "2022-12-31"}, [2, 1]),
        ({"first": "2022-01-01", "last": "2022-12-31"}, [2]),
        ({"first": "2000-01-01", "last": "2099-01-01"}, [3, 2, 1]),
        ({"limit": 1, "first": "2000-01-01"}, [3]),
        ({"before": 3, "limit": 1}, [2]),
    ],
)
def test_timeline(spark, options, want):
    assert [r.id for r in B.timeline(shown(spark, TIMES), **options).orderBy(F.desc("id")).collect()] == want


def test_stats(spark):
    rows = [(1, "linux config", "a"), (2, "linux nfs", "b"), (3, "memory", "c")]
    all_lines = lines(spark, rows)
    every = all_lines.select(F.explode("keys").alias("key"), "id")
    none = spark.createDataFrame([], TOMB)
    assert tuple(B.stats(all_lines, none, every).first()) == (3, 4, 0)
    dead = spark.createDataFrame([(2, "", "h", 0), (2, "", "h", 1)], TOMB)
    assert tuple(B.stats(all_lines, dead, every).first()) == (2, 4, 1)


def test_delete_under(spark):
    rows = [(1, "shared", "a"), (2, "Shared", "b"), (3, "shared", "c"), (4, "other", "d")]
    none = spark.createDataFrame([], TOMB)
    got = U.delete_under(lines(spark, rows), none, "shared", "2024-01-01T00:00:00Z")
    assert ids(got.where("counted")) == [1, 2, 3]
    assert U.delete_under(lines(spark, rows), none, "absent", "x").count() == 0


def test_put_twice_is_put_once(spark):
    old = lines(spark, SIX)
    new = spark.createDataFrame([(1, "/etc/exports", ["Linux", "share"], None), (2, "new", ["a", "A", "-x"], ""), (3, "new", ["b"], ""), (4, "", ["z"], ""), (5, None, ["z"], "")], "seq long, value string, keys array<string>, ts string")
    once = U.bulk_put(old, new, 6)
    got = {r.id: (r.keys, r.value) for r in once.collect()}
    assert got[2][0] == ["linux", "nfs", "export", "network", "share"]
    assert got[7] == (["a", "b"], "new") and len(got) == 7
    twice = U.bulk_put(once, new, 7)
    assert {r.id: (r.keys, r.value) for r in twice.collect()} == got


def test_import_lines(spark):
    texts = ["cmd tools -v ps aux | grep x | wc -l", "-v keyless value", "# comment", "", "2023|note|http://x", "work|a", "Z9|2031-01-01T00:00:00Z|x", "TODO|buy milk", "no separators", "a --value u v"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, line string")
    kv = {r.i: r.kv for r in rows.select("i", S.parse_kv(F.col("line")).alias("kv")).collect()}
    assert (kv[0].keys, kv[0].value) == (["cmd", "tools"], "ps aux | grep x | wc -l")
    assert (kv[1].keys, kv[1].value) == ([], "keyless value")
    assert kv[9].value == "u v" and kv[8] is None
    old = {r.i: r.kv for r in rows.select("i", S.parse_legacy_kv(F.col("line")).alias("kv")).collect()}
    assert (old[4].keys, old[4].value, old[4].noisy) == (["2023", "note"], "http://x", True)
    assert old[5].keys == ["work"] and old[7].keys == ["TODO"] and old[8] is None
    status = {r.i: r.status for r in S.parse_facts(rows, "2024-01-01T00:00:00Z").collect()}
    assert [status[i] for i in (2, 3, 6, 7)] == ["skip", "skip", "unknown", "plain"]


def test_store_lines_of_all_versions(spark):
    texts = ["1|2020-01-01T10:00:00Z|a b|v|w", "2|k|v|w", "3||k|v", "4|2020|v", "x|k|v", "no bar", "0|k|v", "5|2020-01-01|k|"]
    good, bad = S.parse_lines(spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "line string, ord long"))
    got = {r.id: (r.ts, r["keys"], r.value) for r in good.collect()}
    assert got == {1: ("2020-01-01T10:00:00Z", ["a", "b"], "v|w"), 2: ("", ["k"], "v|w"), 3: ("", [], "k|v"), 4: ("", ["2020"], "v"), 5: ("2020-01-01", ["k"], "")}
    assert bad.count() == 3


def test_bundles(spark, tmp_path):
    payload = b"B|blobs/a.txt|5\nhello\nA|2024-01-01T00:00:00Z|k|v\n"
    for name, raw in {"a": S.frame_bundle(b"n", 7, payload), "b": S.frame_bundle(b"n", 6, b"old"), "c": S.frame_bundle(b"m", 1, b"x")[:-1], "d": b"junk"}.items():
        (tmp_path / f"{name}.aisb").write_bytes(raw)
    found = S.read_bundles(spark, str(tmp_path))
    assert sorted((r.path[-6], r.status, r.seq) for r in found.collect()) == [("a", "ok", 7), ("b", "ok", 6), ("c", "damaged", None), ("d", "damaged", None)]
    last = S.latest_bundles(found)
    assert [(r.seq, bytes(r.payload)) for r in last.collect()] == [(7, payload)]
    assert [(r.path, bytes(r.content)) for r in S.embedded_bodies(last).collect()] == [("blobs/a.txt", b"hello")]


def test_text_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    lines(spark, SIX).select(store_line(F.col("ts"), F.col("keys"), F.col("value"), F.col("id"))).write.text(path)
    back, bad = S.parse_lines(S.read_text(spark, path))
    assert sorted((r.id, r["keys"], r.value) for r in back.collect()) == [(i, k.split(), v) for i, k, v in SIX] and bad.count() == 0
    dumped = lines(spark, SIX).select("id", dump_line(F.col("keys"), F.col("value")).alias("line"))
    kv = dumped.select("id", S.parse_kv(F.col("line")).alias("kv"))
    assert sorted((r.id, r.kv["keys"], r.kv.value) for r in kv.collect()) == [(i, k.split(), v) for i, k, v in SIX]
