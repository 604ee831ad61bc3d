"""Scoring keyed recall against text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grade(rows: DataFrame) -> DataFrame:
    """Add correct and recall to rows (answer, expect): all, and the share of, expected parts that the answer holds; blank without any."""
    met = F.size(F.filter("expect", lambda e: F.contains(F.lower("answer"), F.lower(e))))
    asked = F.size("expect")
    some = asked > 0
    return rows.withColumn("correct", F.when(some, met == asked)).withColumn("recall", F.when(some, F.round(met / asked, 3)))


def largest_root(trials: DataFrame, arm: str = "search") -> DataFrame:
    return trials.where(F.col("arm") == arm).agg(F.max_by("root", F.struct("root_bytes", "root")).alias("root"))


def tokens_by_question(trials: DataFrame, index_arm: str = "index", search_arm: str = "search") -> DataFrame:
    """(qid, index_tokens, search_tokens, ratio); the search arm counts at its largest root only."""
    top = largest_root(trials, search_arm).withColumnRenamed("root", "top")
    of = lambda arm, more: F.avg(F.when((F.col("arm") == arm) & more, F.col("total_tokens")))
    rows = trials.crossJoin(F.broadcast(top))  # top has one row
    out = rows.groupBy("qid").agg(of(index_arm, F.lit(True)).alias("index_tokens"), of(search_arm, F.col("root") == F.col("top")).alias("search_tokens"))
    return out.withColumn("ratio", F.when(F.col("index_tokens") > 0, F.col("search_tokens") / F.col("index_tokens")))


def arm_summary(trials: DataFrame) -> DataFrame:
    graded = F.col("correct").isin("True", "False")
    return trials.groupBy("arm").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("total_tokens").alias("mean_tokens"),
        F.stddev_pop("total_tokens").alias("sd_tokens"),
        F.expr("percentile(total_tokens, 0.5)").alias("median_tokens"),
        F.avg("retrieval_tokens").alias("mean_retrieval"),
        F.avg("latency_ms").alias("mean_latency"),
        F.count_if(F.col("correct") == "True").alias("correct"),
        F.count_if(graded).alias("graded"),
        F.avg("recall").alias("mean_recall"),
    )


def ratio_summary(trials: DataFrame) -> DataFrame:
    by = tokens_by_question(trials)
    ratios = by.agg(F.avg("ratio").alias("mean_ratio"), F.expr("percentile(ratio, 0.5)").alias("median_ratio"))
    of = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("retrieval_tokens")))
    payload = trials.agg((of("search") / of("index")).alias("payload_ratio"))
    return ratios.crossJoin(payload)  # one row each


def size_sweep(trials: DataFrame) -> DataFrame:
    """(root, files, bytes, search_tokens, index_tokens): search by root size against the flat mean of the index."""
    flat = trials.where("arm = 'index'").agg(F.avg("total_tokens").alias("index_tokens"))
    out = trials.where("arm = 'search'").groupBy("root").agg(F.max("root_files").alias("files"), F.max("root_bytes").alias("bytes"), F.avg("total_tokens").alias("search_tokens"))
    return out.crossJoin(F.broadcast(flat))  # flat has one row


def question_misses(trials: DataFrame) -> DataFrame:
    """(qid, index_mean, search_mean, ratio, miss): a miss is an arm that was graded and never correct."""
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("total_tokens")))
    bad = lambda arm: (F.count_if((F.col("arm") == arm) & F.col("correct").isin("True", "False")) > 0) & (F.count_if((F.col("arm") == arm) & (F.col("correct") == "True")) == 0)
    out = trials.groupBy("qid").agg(mean("index").alias("index_mean"), mean("search").alias("search_mean"), bad("search").alias("search_miss"), bad("index").alias("index_miss"))
    ratio = F.when(F.col("index_mean") > 0, F.round(F.col("search_mean") / F.col("index_mean"), 1))
    miss = F.when(F.col("search_miss"), "search").when(F.col("index_miss"), "index").otherwise("")
    return out.select("qid", "index_mean", "search_mean", ratio.alias("ratio"), miss.alias("miss"))


def compare_retrieval(expect: DataFrame, keyed: DataFrame, searched: DataFrame, size_of: DataFrame) -> DataFrame:
    """(arm, precision, recall, tokens) of two hit sets (qid, id) against expect (qid, id); size_of: (id, bytes)."""
    hits = keyed.select("qid", "id").distinct().withColumn("arm", F.lit("keyed")).unionByName(searched.select("qid", "id").distinct().withColumn("arm", F.lit("search")))
    good = expect.select("qid", "id").distinct().withColumn("good", F.lit(1))
    found = hits.join(good, ["qid", "id"], "left").join(size_of, "id")
    by = found.groupBy("arm").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.coalesce("good", F.lit(0))).alias("right"), F.sum("bytes").alias("bytes"))
    total = good.agg(F.count(F.lit(1)).alias("wanted"))
    out = by.crossJoin(F.broadcast(total))  # total has one row
    return out.select("arm", "hits", (F.col("right") / F.col("hits")).alias("precision"), (F.col("right") / F.col("wanted")).alias("recall"), F.floor(F.col("bytes") / 4).alias("tokens"))


def tool_log_summary(log: DataFrame) -> DataFrame:
    """(tool, calls, chars, tokens, mean_latency, p50_latency) of (tool, chars, latency_ms)."""
    tokens = F.greatest(F.lit(1).cast("long"), F.floor(F.col("chars") / 4))
    return log.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("chars").alias("chars"),
        F.sum(tokens).alias("tokens"),
        F.avg("latency_ms").alias("mean_latency"),
        F.expr("percentile(latency_ms, 0.5)").alias("p50_latency"),
    )


def arm_progress(trials: DataFrame) -> DataFrame:
    return trials.groupBy("arm").agg(F.floor(F.sum("total_tokens") / F.count(F.lit(1))).alias("mean_tokens"), F.count(F.lit(1)).alias("runs"))
