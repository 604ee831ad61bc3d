"""Queries that read whole texts, on texts whose end matters."""

from keyloom.plans import catalog

from . import oracle


def documents(spark, path):
    end = "x" * 500
    rows = [(1, end + " The end|\n", "en", "A"), (2, "the start", "de", "A"), (3, end, "en", "B"), (4, "12.50", "de", "B")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def test_search_arm_finds_what_stands_late(spark, tmp_path):
    con = documents(spark, tmp_path)
    df = catalog.QUERIES["retrieval_comparison_whole"](spark, str(tmp_path))
    assert {r.arm: r.hits for r in df.collect()}["search"] == 2
    oracle.same(df, con, catalog.ORACLES["retrieval_comparison_whole"])


def test_fold_and_number_take_the_whole_text(spark, tmp_path):
    con = documents(spark, tmp_path)
    df = catalog.QUERIES["key_fold_whole"](spark, str(tmp_path))
    out = {r.doc_id: r for r in df.collect()}
    assert out[1].stored.endswith(" The end__") and out[4].num == 12.5
    oracle.same(df, con, catalog.ORACLES["key_fold_whole"])
