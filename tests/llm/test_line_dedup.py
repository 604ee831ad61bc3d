from pyspark.sql import functions as F

from keyloom.llm import line_dedup as D


def chunks(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(D.line_chunks(F.col("t")).alias("c")).first()
    return [(c.pos, c.n_lines, c.chunk) for c in row.c]


def test_chunks_join_to_the_text(spark):
    for text in ["", "a", "a\nb", "\n\n\n", "\n".join(f"line {i}" for i in range(100)), "x" * 50_000 + "\ny", "é\r\n\n"]:
        got = chunks(spark, text)
        assert "\n".join(c for _, _, c in got) == text and sum(n for _, n, _ in got) == text.count("\n") + 1
        assert [p for p, _, _ in got] == list(range(len(got)))
    assert chunks(spark, None) == []


def test_boundaries_survive_lines_in_front(spark):
    text = "\n".join(f"line number {i}" for i in range(60))
    a, b = chunks(spark, text), chunks(spark, "new\nlines\nhere\n" + text)
    assert len({c for _, _, c in a} & {c for _, _, c in b}) >= len(a) - 1


def test_repeated_chunks_go_but_for_the_first(spark):
    block = "\n".join(f"shared line {i}" for i in range(40))
    rows = [(3, "own three\n" + block + "\nend three"), (1, "own one\nmore\n" + block), (2, "nothing shared\nat all"), (None, block), (9, None), (8, ""), (7, "short"), (6, "short")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lines_in string")
    out = {r.doc_id: r for r in D.line_dedup(frame).collect()}
    assert out[1].text == rows[1][1] and out[2].text == rows[2][1] and out[None].text == block
    assert out[3].lines_removed > 20 and out[3].text.startswith("own three") and out[3].lines_in == 42
    assert out[9].text is None and out[9].lines_in == 0 and out[8].text == "" and out[7].text == out[6].text == "short"


def test_copies_lose_whole_text_and_rows_stay(spark):
    block = "\n".join(f"l {i}" for i in range(30))
    frame = spark.createDataFrame([(i % 50, block) for i in range(100)], "doc_id long, text string")
    out = D.line_dedup(frame).collect()
    assert len(out) == 100 and all(r.text == block for r in out if r.doc_id == 0)
    multi = sum(n for _, n, _ in chunks(spark, block) if n > 1)
    assert all(r.lines_removed == multi for r in out if r.doc_id != 0)
    assert D.line_dedup(frame.where("false")).count() == 0


def test_columns_of_other_names(spark):
    text = "\n".join(f"line {i} of many" for i in range(40))
    plain = spark.createDataFrame([(1, text), (2, "x\n" + text), (3, None)], "doc_id long, text string")
    names = ("gone", "gone_id", "chunks", "left", "row", "key", "chunk", "first", "pos", "n", "c", "n_lines", "seen", "bucket_", "part_", "word_", "kept a.b")
    odd = plain.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in names])
    out = {r.doc_id: r for r in D.line_dedup(odd).collect()}
    want = {r.doc_id: (r.text, r.lines_in, r.lines_removed) for r in D.line_dedup(plain).collect()}
    assert {i: (r.text, r.lines_in, r.lines_removed) for i, r in out.items()} == want and want[2][2] > 0
    assert all(r[c] == f"{c}{i}" for i, r in out.items() for c in names)
