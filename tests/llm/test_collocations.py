"""Collocations against plain counters."""

import random
import re
from collections import Counter, defaultdict

import pytest

from keyloom.llm import collocations as C

from .. import oracle

SCHEMA = "doc_id long, text string, lang string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=30, longest=4, subsumed=80, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        often = {p: n for p, n in f.items() if len(p) >= 2 and n >= least}
        rows = []
        for p, a in often.items():
            inside = any(len(q) > len(p) and 100 * n >= subsumed * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, n in often.items())
            if not inside:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, r[2].decode(), -r[1], r[3], r[4], totals[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def told(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def texts(seed, n, marks=" .\n\t,;  "):
    rng = random.Random(seed)
    words = ["New", "york", "of", "the", "times", "a", "Ünder", "über", "x1"]
    out = []
    for i in range(n):
        text = ""
        for _ in range(rng.randrange(0, 40)):
            text += rng.choice([*words, "new york", "of the new york"]) + rng.choice(marks)
        out.append((i, text, rng.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("options", [{}, {"least": 5}, {"least": 8, "longest": 3, "top": 10}, {"least": 3, "longest": 5, "subsumed": 50}, {"least": 2, "longest": 2}])
def test_small_texts(spark, options):
    docs = texts(1, 150)
    assert told(C.collocations(spark.createDataFrame(docs, SCHEMA), **options)) == plain(docs, **options)


def test_chunks_windows_and_hot_stripes_change_nothing(spark):
    """A few tokens a chunk, texts split in the middle of pieces, stripes in many parts."""
    docs = texts(2, 60, marks="  \t.") + [(100, "of the new york " * 300, "en"), (101, "w" * 500 + " the of", "en")]
    whole = plain(docs, least=4)
    frame = spark.createDataFrame(docs, SCHEMA).coalesce(1)

    def small(f):
        def run(batches):
            kept = C.WINDOW, C.CHUNK, C.ENTRIES
            try:
                C.WINDOW, C.CHUNK, C.ENTRIES = 37, 150, 40
                yield from f(batches)
            finally:
                C.WINDOW, C.CHUNK, C.ENTRIES = kept

        return run

    words, known = C.word_stripes, C.phrase_stripes
    try:
        C.word_stripes, C.phrase_stripes, C.HOT_WORDS = small(words), lambda b, *a: small(lambda c: known(c, *a))(b), 20
        assert told(C.collocations(frame, least=4)) == whole
    finally:
        C.word_stripes, C.phrase_stripes, C.HOT_WORDS = words, known, 1 << 16


def test_chunk_borders_in_one_process():
    """Every phrase is counted once, wherever chunks end."""
    import numpy as np
    import pyarrow as pa

    docs = texts(3, 40, marks="  \t.") + [(100, "a b c d e " * 100, "en")]
    batch = pa.RecordBatch.from_arrays([pa.array([d[2] or "und" for d in docs]), pa.array([d[1] for d in docs])], ["lang", "text"])
    every = C.Sieve(np.full(C.BITS >> 6, np.uint64(2**64 - 1)), {("en", "the"): 3})
    window, chunk = C.WINDOW, C.CHUNK

    def counts(pairs, longest):
        out = Counter()
        for b in C.phrase_stripes([batch], every, pairs, longest):
            for r in b.to_pylist():
                words = r["next"].split(" ")
                for word, n in zip(words, r["n"].split(" ") if r["n"] else [1] * len(words), strict=True):
                    out[r["lang"], r["size"], f"{r['prefix']} {word}"] += int(n)
        return out

    plain_counts = (counts(None, 2), counts(every, 4))
    try:
        for C.WINDOW, C.CHUNK in ((10, 30), (64, 200), (1, 1)):
            assert (counts(None, 2), counts(every, 4)) == plain_counts
    finally:
        C.WINDOW, C.CHUNK = window, chunk
    assert plain_counts[0]["en", 2, "e a"] == 99 and plain_counts[1]["en", 4, "d e a b"] == 99


def test_nulls_blank_texts_repeats_other_columns_and_empty_tables(spark):
    docs = [(1, None, "en"), (1, "", None), (2, " \t.,", "en"), (3, "a b " * 40, None), (3, "a b " * 40, None), (None, "a b. c", "und")]
    frame = spark.createDataFrame([(*d, 1, "y") for d in docs], SCHEMA + ", phrase int, n string")
    assert told(C.collocations(frame)) == plain(docs)
    assert told(C.collocations(frame.limit(0))) == []
    assert told(C.collocations(frame.where("doc_id = 1"))) == []


def test_exact_scores_of_counts_beyond_64_bits(spark):
    a = 9_000_000_000_000_000
    found = spark.createDataFrame([("en", 1, "x", a + 1), ("en", 1, "y", a + 3), ("en", 2, "x y", a)], "lang string, size int, phrase string, n long")
    assert [tuple(r) for r in C.scored(found, 4, 80).collect()] == [("en", "x y", a, a + 1, a + 3, 2000000 * a // (2 * a + 4))]


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    oracle.same(C.op12_collocations(spark, sf), oracle.connect(sf), C.OP12_SQL)
