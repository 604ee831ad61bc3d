import re
from collections import defaultdict

import pytest

from keyloom.llm import mixing
from keyloom.llm.common import documents

SF = "/root/testdata/sf0.01"


def level(sizes, weights):
    """Targets by sharing the excess again and again."""
    total, capped = sum(sizes.values()), {}
    while True:
        left = [s for s in sizes if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(docs, rows):
    sizes, longest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for _, text, source in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    targets = level(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] + 1
    assert sum(taken.values()) <= sum(sizes.values())


def test_documents(spark):
    docs = [(r.doc_id, r.text, r.source) for r in documents(spark, SF).collect()]
    rows = mixing.op1_mixing(spark, SF).collect()
    check(docs, rows)
    again = mixing.op1_mixing(spark, SF).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_small_source_is_repeated_and_nulls(spark):
    docs = [(i, "w " * (i % 7), "big") for i in range(300)] + [(1000 + i, "a b c", "tiny") for i in range(5)]
    docs += [(None, "x y", None), (7, None, None), (8, "", "empty"), (9, "q", None), (9, "q", None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(frame).collect()
    check(docs, rows)
    assert {r.taken for r in rows if r.source == "tiny"} == {9}


def test_mixed_repeats_rows(spark):
    docs = [(i, "w w w w", "big", 1) for i in range(50)] + [(100 + i, "a b", "tiny", 2) for i in range(3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    out = mixing.mixed(frame)
    assert out.columns == frame.columns
    got = [r.doc_id for r in out.collect()]
    assert all(got.count(100 + i) == 3 for i in range(3))


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_columns_of_other_names(spark):
    plain = spark.createDataFrame([(i, "a b c " * (i % 4 + 1), f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    names = ("h", "cum", "bucket", "source_rows", "its_source", "src", "offset", "copy", "row", "size", "taken", "target", "weight", "finish", "range", "run", "place")
    odd = plain.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in names])
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.mixed(plain).collect()) and rows
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
