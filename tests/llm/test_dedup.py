import random

import pytest

from keyloom.llm import minhash_dedup as M

from . import brute_dedup as B

SCHEMA = "doc_id long, text string"


def check(spark, docs, n):
    rows = M.near_duplicates(spark.createDataFrame(docs, SCHEMA), shingle=n).collect()
    want = B.components(docs, n)
    sizes = {i: len(B.shingles(t, n)) for i, t in docs}
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == sorted((i, sizes[i], want[i], want[i] == i) for i, _ in docs)


@pytest.mark.parametrize("n", [2, 5])
def test_copies_near_copies_and_shared_passages(spark, n, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    docs = []
    for i in range(60):
        own = [word() for _ in range(rnd.choice([3, 20, 60, 120]))]
        docs.append(own + passage if i % 3 == 0 else own)
    base = [word() for _ in range(100)]
    for _ in range(40):  # a chain of near copies, each of an earlier one
        near = list(rnd.choice(docs[-10:]) if rnd.random() < 0.3 else base)
        for _ in range(rnd.randint(0, 6)):
            near[rnd.randrange(len(near))] = word()
        docs.append(near)
    docs += [list(rnd.choice(docs)) for _ in range(20)]
    rnd.shuffle(docs)
    check(spark, [(i, " ".join(d)) for i, d in enumerate(docs)], n)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "É two"), (9, "é two")]
    check(spark, docs, 2)
    frame = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "x y z"), (2, "x y z"), (3, "q")], SCHEMA)
    rows = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in M.near_duplicates(frame).collect())
    assert rows == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    assert M.near_duplicates(frame.where("false")).count() == 0


def test_deduplicated_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(1, text, "a"), (2, text + " x", "b"), (3, "other words altogether here now", "c")], "doc_id long, text string, kept string")
    out = M.deduplicated(frame)
    assert out.columns == frame.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_columns_of_other_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    frame = spark.createDataFrame([(1, text), (2, text + " x"), (3, "q")], "doc_id long, text string")
    odd = frame.selectExpr("*", *[f"'{c}!' AS {c}" for c in ("gone_id", "row", "class", "component", "sig", "kept", "n_shingles", "bucket_", "part_", "id", "node", "top")])
    out = M.deduplicated(odd)
    assert out.columns == odd.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, odd.where("doc_id <> 2").collect()))
    assert sorted(map(tuple, M.near_duplicates(odd).collect())) == sorted(map(tuple, M.near_duplicates(frame).collect()))


def test_pages_of_one_template_do_not_meet(spark):
    """Pages with 60 common and 35 own words are no near-duplicates; what they are posted under must not grow with the square of their number."""
    rnd = random.Random(4)
    n = 1000
    common = [f"c{i}" for i in range(60)]
    docs = [(i, " ".join(common + [f"o{rnd.randrange(10**9)}" for _ in range(35)])) for i in range(n)]
    frame = spark.createDataFrame(docs, SCHEMA)
    signed = M._sets(frame, 2, "sig").selectExpr("doc_id AS id", "size(sig) AS n", "sig")
    lists = M.prefixes(signed).selectExpr("explode(prefix.token) AS token").groupBy("token").count().collect()
    assert sum(r["count"] * (r["count"] - 1) // 2 for r in lists) < 0.01 * n * (n - 1) / 2
    assert M.near_duplicates(frame).where("kept").count() == n


def test_neighbours_in_a_ring_join(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(80):  # neighbours in a ring are near each other, opposites are not
        near = list(base)
        for k in range(16):
            near[(i * 4 + k * 3) % 100] = f"x{(i * 4 + k * 3) % 100}"
        if rnd.random() < 0.3:
            near[rnd.randrange(100)] = f"own{i}"
        docs.append((i, " ".join(near)))
    check(spark, docs, 2)


def joined_columns(frame):
    """Columns that the joins of a plan get, before it is known how large anything is."""
    found, todo = set(), [frame._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join" and "broadcast" not in node.hint().toString():
            found |= {side.output().apply(i).name() for side in below for i in range(side.output().size())}
        todo += below
    return found


def test_signatures_stay_where_they_are(spark):
    """What meets the ids in a join are sketches of a fixed size; signatures are eight times as large, and were shuffled when the ids grew over Spark's bound for broadcasts."""
    signed = M._sets(spark.createDataFrame([(i, f"a{i} b c d e") for i in range(20)], SCHEMA), 2, "sig").selectExpr("doc_id AS id", "size(sig) AS n", "sig")
    found = M.sketches_of(signed.where("id < 7").select("id"), signed)
    assert sorted(r.id for r in found.collect()) == list(range(7))
    assert "sketch" in joined_columns(found) and "sig" not in joined_columns(found)


def test_tables_that_nothing_reads_are_dropped(spark, monkeypatch):
    made = []

    def saved(df, label, real=M.saved):
        made.append((label, out := real(df, label)))
        return out

    monkeypatch.setattr(M, "saved", saved)
    text = " ".join(f"w{i}" for i in range(50))
    out = M.near_duplicates(spark.createDataFrame([(1, text), (2, text + " x"), (3, text), (4, "q")], SCHEMA))
    left = set()
    for label, table in made:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            left |= {c for c in table.columns if c in ("sig", "shingles", "hub", "prefix")}
    assert not left and sorted((r.doc_id, r.component_id) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    """The driver holds the plan of every round, so a round must not repeat its join where it names it again."""
    sizes = []

    def saved(df, label, real=M.saved):
        sizes.append((label, len(df._jdf.queryExecution().sparkPlan().treeString().splitlines())))
        return real(df, label)

    monkeypatch.setattr(M, "saved", saved)
    found = M.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()
    assert sorted(map(tuple, found)) == [(i, 0) for i in range(10)]
    assert max(n for _, n in sizes) < 150, sizes
