"""Retrieval evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators.recall import recall_batch
from ..session import table
from . import tables as T
from .registry import query

W = T.WITH_TRIALS


@query("""WITH g AS (SELECT conv_id, turn, lower(text) AS a, CASE WHEN turn % 4 = 3 THEN [] ELSE ['the', 'xyz', 'an'][1:turn % 4 + 1] END AS expect FROM conversations), m AS (SELECT *, len(list_filter(expect, lambda e: contains(a, e))) AS met, len(expect) AS asked FROM g)
SELECT conv_id, turn, CASE WHEN asked > 0 THEN met = asked END AS correct, CASE WHEN asked > 0 THEN round(met / asked, 3) END AS recall FROM m""")
def grade(spark, sf):
    c = table(spark, sf, "conversations")
    every = F.array(F.lit("the"), F.lit("XYZ"), F.lit("an"))
    expect = F.when(F.col("turn") % 4 == 3, F.array().cast("array<string>")).otherwise(F.slice(every, F.lit(1), (F.col("turn") % 4 + 1).cast("int")))
    return E.grade(c.select("conv_id", "turn", F.col("text").alias("answer"), expect.alias("expect"))).select("conv_id", "turn", "correct", "recall")


_BY = """, top AS (SELECT arg_max(root, root_bytes) AS root FROM trials WHERE arm = 'search'),
byq AS (SELECT qid, avg(total_tokens) FILTER (arm = 'index') AS index_tokens, avg(total_tokens) FILTER (arm = 'search' AND root = (SELECT root FROM top)) AS search_tokens FROM trials GROUP BY qid) """


@query(W + _BY + "SELECT *, CASE WHEN index_tokens > 0 THEN search_tokens / index_tokens END AS ratio FROM byq")
def tokens_by_question(spark, sf):
    return E.tokens_by_question(T.trials(spark, sf))


@query(W + """SELECT arm, count(*) AS runs, avg(total_tokens) AS mean_tokens, stddev_pop(total_tokens) AS sd_tokens, quantile_cont(total_tokens, 0.5)::DOUBLE AS median_tokens, avg(retrieval_tokens) AS mean_retrieval, avg(latency_ms) AS mean_latency,
  count(*) FILTER (correct = 'True') AS correct, count(*) FILTER (correct IN ('True', 'False')) AS graded, avg(recall) AS mean_recall FROM trials GROUP BY arm""")
def arm_summary(spark, sf):
    return E.arm_summary(T.trials(spark, sf))


@query(W + _BY + ", r AS (SELECT search_tokens / index_tokens AS ratio FROM byq WHERE index_tokens > 0) SELECT (SELECT avg(ratio) FROM r) AS mean_ratio, (SELECT quantile_cont(ratio, 0.5) FROM r) AS median_ratio, (SELECT avg(retrieval_tokens) FILTER (arm = 'search') / avg(retrieval_tokens) FILTER (arm = 'index') FROM trials) AS payload_ratio")
def ratio_summary(spark, sf):
    return E.ratio_summary(T.trials(spark, sf))


@query(W + "SELECT root, max(root_files) AS files, max(root_bytes) AS bytes, avg(total_tokens) AS search_tokens, (SELECT avg(total_tokens) FROM trials WHERE arm = 'index') AS index_tokens FROM trials WHERE arm = 'search' GROUP BY root")
def size_sweep(spark, sf):
    return E.size_sweep(T.trials(spark, sf))


@query(W + """, m AS (SELECT qid, avg(total_tokens) FILTER (arm = 'index') AS index_mean, avg(total_tokens) FILTER (arm = 'search') AS search_mean, count(*) FILTER (arm = 'search' AND correct <> '') > 0 AND count(*) FILTER (arm = 'search' AND correct = 'True') = 0 AS sm,
  count(*) FILTER (arm = 'index' AND correct <> '') > 0 AND count(*) FILTER (arm = 'index' AND correct = 'True') = 0 AS im FROM trials GROUP BY qid) SELECT qid, index_mean, search_mean, CASE WHEN index_mean > 0 THEN round(search_mean / index_mean, 1) END AS ratio, CASE WHEN sm THEN 'search' WHEN im THEN 'index' ELSE '' END AS miss FROM m""")
def question_misses(spark, sf):
    return E.question_misses(T.trials(spark, sf))


_CMP = """WITH d AS (SELECT doc_id AS id, source, lang, lower(text) AS t, strlen(text) AS bytes FROM documents), q AS (SELECT DISTINCT source AS qid FROM d),
expect AS (SELECT source AS qid, id FROM d WHERE lang = 'en'), keyed AS (SELECT source AS qid, id FROM d WHERE lang = 'en' OR id % 9 = 0), searched AS (SELECT source AS qid, id FROM d WHERE contains(t, 'the')),
hits AS (SELECT 'keyed' AS arm, * FROM keyed UNION ALL SELECT 'search', * FROM searched)
SELECT arm, count(*) AS hits, count(e.id) / count(*) AS precision, count(e.id) / (SELECT count(*) FROM expect) AS recall, sum(d.bytes)::BIGINT // 4 AS tokens FROM hits h LEFT JOIN expect e ON e.qid = h.qid AND e.id = h.id JOIN d ON d.id = h.id GROUP BY arm"""


def _comparison(spark, sf, text):
    """Keyed recall against a search for 'the' in the column text."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "text")
    mark = F.when((F.col("lang") == "en") | (F.col("id") % 9 == 0), "wanted").otherwise("other")
    postings = d.select(F.explode(F.array(F.translate("source", "ABC", "abc"), mark)).alias("key"), "id")
    queries = d.select("source").distinct().select(F.col("source").alias("qid"), F.array(F.col("source"), F.lit("wanted")).alias("keys"))
    searched = d.where(F.contains(F.lower(text), F.lit("the"))).select(F.col("source").alias("qid"), "id")
    expect = d.where("lang = 'en'").select(F.col("source").alias("qid"), "id")
    return E.compare_retrieval(expect, recall_batch(postings, queries), searched, d.select("id", F.octet_length("text").alias("bytes")))


@query(_CMP)
@query(_CMP, name="retrieval_comparison_whole")
def retrieval_comparison(spark, sf):
    return _comparison(spark, sf, F.col("text"))


@query("SELECT role AS tool, count(*) AS calls, sum(length(text))::BIGINT AS chars, sum(greatest(1, length(text) // 4))::BIGINT AS tokens, avg(turn * 10.0) AS mean_latency, quantile_cont(turn * 10.0::DOUBLE, 0.5) AS p50_latency FROM conversations GROUP BY role")
def tool_log_summary(spark, sf):
    c = table(spark, sf, "conversations")
    return E.tool_log_summary(c.select(F.col("role").alias("tool"), F.length("text").cast("long").alias("chars"), (F.col("turn") * 10.0).cast("double").alias("latency_ms")))


@query(W + "SELECT arm, (sum(total_tokens) // count(*))::BIGINT AS mean_tokens, count(*) AS runs FROM trials GROUP BY arm")
def arm_progress(spark, sf):
    return E.arm_progress(T.trials(spark, sf))


@query(W + "SELECT qid, arm, root, repeat, correct FROM trials")
def sanitised_trials(spark, sf):
    return T.trials(spark, sf).select("qid", "arm", "root", F.col("repeat").cast("long").alias("repeat"), "correct")
