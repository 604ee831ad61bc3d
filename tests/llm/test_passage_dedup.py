import random
import time
from collections import defaultdict

import corpus_pipeline as P
from keyloom.llm import line_dedup
from keyloom.llm import passage_dedup as D

from . import brute_passage

SF = "/root/testdata/sf0.001"


def cut(spark, rows):
    return {r.doc_id: r for r in D.passage_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def windows(text):
    """Every range of two lines or more and over 50 words without blank lines at its ends."""
    lines = text.split("\n")
    for i, a in enumerate(lines):
        words = 0
        for j in range(i, len(lines)):
            words += len(lines[j].split())
            if j > i and words > 50 and a.split() and lines[j].split():
                yield "\n".join(lines[i : j + 1])


def test_short_passages_go_wherever_they_stand(spark):
    for seed in range(12):  # with any boundaries
        passage = "\n".join(" ".join(f"p{seed}x{i}" for i in range(k, k + 26)) for k in (0, 26))
        rows = [(1, f"own {seed} one\n{passage}\nend one"), (2, f"{passage}\nend {seed} two"), (3, f"own three {seed}\n{passage}"), (None, passage)]
        out = cut(spark, rows)
        assert out[1].text == rows[0][1] and out[None].text == passage
        assert out[2].text == f"end {seed} two" and out[3].text == f"own three {seed}" and out[2].lines_removed == 2


def test_one_copy_of_a_periodic_text_stays(spark):
    line = " ".join(f"w{i}" for i in range(20))
    out = cut(spark, [(1, "\n".join([line] * 30)), (2, None), (3, ""), (4, "a")])
    assert out[1].text.split("\n")[:3] == [line] * 3 and 0 < out[1].lines_removed <= 27 and out[1].lines_in == 30
    assert out[2].text is None and out[2].lines_in == 0 and out[3].text == "" and out[4].text == "a"


def test_no_passage_keeps_two_places(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect() if r.text is not None}
    out = {r.doc_id: r for r in D.passage_dedup(docs).collect()}
    places = defaultdict(set)
    for i, text in before.items():
        for w in windows(text):
            places[w].add(i)
    repeated = {w: ids for w, ids in places.items() if len(ids) > 1}
    assert repeated
    for w, ids in repeated.items():
        assert sum(f"\n{w}\n" in f"\n{out[i].text}\n" for i in ids) <= 1
    lines = {x for t in before.values() for x in t.split("\n")}
    assert lines <= {x for r in out.values() if r.text is not None for x in r.text.split("\n")}
    assert sum(r.lines_removed for r in out.values()) > sum(r.lines_removed for r in line_dedup.line_dedup(docs).collect())


def test_stage_cuts_passages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a = {r.doc_id: r.text for r in dict(P.STAGES)["line_dedup"](spark, docs, SF).collect()}
    assert a == {r.doc_id: r.text for r in D.passage_dedup(docs).collect()}


def test_documents_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = dict(zip([d for d, _ in docs], brute_passage.passage_dedup(docs)))
    out = D.op8_passage_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.text for r in out} == want
    assert any(want[d] != t for d, t in docs)


def test_random_texts_against_brute_force(spark):
    """Few short and long lines, blank ones among them, so that ranges overlap, repeat inside a text and touch its ends."""
    rng = random.Random(4)
    some = ["", " ", "a", *[" ".join(f"w{i}x{j}" for j in range(n)) for i, n in enumerate((3, 20, 26, 60))]]
    docs = [(i if i % 9 else None, "\n".join(rng.choice(some) for _ in range(rng.randrange(0, 25)))) for i in range(120)] + [(500, None), (501, "")]
    got = {(r.n, r.doc_id): r.text for r in D.passage_dedup(spark.createDataFrame([(d, t, n) for n, (d, t) in enumerate(docs)], "doc_id long, text string, n long")).collect()}
    assert got == {(n, d): t for n, ((d, _), t) in enumerate(zip(docs, brute_passage.passage_dedup(docs)))}


def test_work_grows_with_the_lines_of_a_text(spark):
    """Two equal texts of 20,000 lines, of which the second goes but for what line order decides."""
    text = "\n".join(" ".join(f"l{i}w{j}" for j in range(30)) for i in range(20_000))
    began = time.time()
    out = cut(spark, [(1, text), (2, text)])
    took = time.time() - began
    assert out[1].text == text and out[2].text == "" and out[2].lines_removed == 20_000
    began = time.time()
    half = "\n".join(text.split("\n")[:10_000])
    assert cut(spark, [(1, half), (2, half)])[2].text == ""
    assert took < 4 * (time.time() - began) + 5
