"""Texts whose end or size is odd, split and stored as bodies."""

import time

from pyspark.sql import functions as F

from keyloom.functions import text as X
from keyloom.operators import upsert as U
from keyloom.plans import catalog

from . import oracle
from .test_bodies import alike

ENDS = ["ab \t\u2028", "ab \x85", "ab \n\u2029", "ab\r\n", " \n ", "", None, "a\n b", "a\n\n\t", "\nb", "x" * 65537, "x" * 65536, "é" * 32769, "y" * 70000 + "\n ", "a\n b", "\n" * 5000]


def documents(spark, path, texts):
    rows = [(n, t) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


def test_ends_are_trimmed_as_in_sql(spark, tmp_path):
    con = documents(spark, tmp_path, ENDS)
    for name in ("doc_split", "stored_bodies"):
        oracle.same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])


def test_many_line_breaks_are_read_once(spark):
    d = spark.createDataFrame([("\n" * 100_000,), ("\n" * 100_000 + "a",)], "t string")
    began = time.time()
    assert [r[0] for r in d.select(X.has_interior_newline(F.col("t"))).collect()] == [False, True]
    assert time.time() - began < 15


def test_digests_and_not_texts_meet_the_lines(spark, tmp_path):
    documents(spark, tmp_path, ENDS)
    above = catalog.QUERIES["stored_bodies"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString().split("Join")[0]
    assert "digest" in above and "md5(" not in above


def test_bodies_meet_their_numbers_where_they_lie(spark, tmp_path):
    a, b = alike()
    rows = spark.createDataFrame([(1, a), (2, b), (3, a), (4, "one line"), (5, "c\nd")], "seq long, value string").selectExpr("seq", "value", "'2024' AS ts")
    split = U.split_documents(rows)
    moved = U.moved_documents(split)
    U.write_bodies(split, f"{tmp_path}/once", moved)
    U.write_bodies(U.placed_documents(split, moved), f"{tmp_path}/placed")
    once, placed = (sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{n}").select("path", "body").collect())) for n in ("once", "placed"))
    assert once == placed and sorted(body for _, body in once) == sorted([a, b, "c\nd"]) and len({path for path, _ in once}) == 3
