"""Validation and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import write_reason
from . import views


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason) of rows with keys and value."""
    judged = rows.withColumn("reason", write_reason(F.col("keys"), F.col("value")))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def identity_audit(lines: DataFrame) -> DataFrame:
    """Values that two or more records hold."""
    return lines.groupBy("value").agg(F.countDistinct("id").alias("records")).where("records > 1")


def coherence_audit(postings: DataFrame, shown: DataFrame) -> DataFrame:
    """(key, id, side): postings without a record that shows the key, and the other way round."""
    told = views.first_link(shown).select(F.explode("ekeys").alias("key"), "id")
    both = postings.select("key", "id", F.lit(1).alias("p")).join(told.select("key", "id", F.lit(1).alias("r")), ["key", "id"], "full_outer")
    return both.where("p IS NULL OR r IS NULL").select("key", "id", F.when(F.col("p").isNull(), "record").otherwise("posting").alias("side"))


def orphan_documents(blobs: DataFrame, lines: DataFrame, tomb: DataFrame | None = None) -> DataFrame:
    """(path, side): bodies that no record names, and records whose body is absent. With tomb, dead records name nothing."""
    named = lines if tomb is None else views.live(lines, tomb)
    named = named.select(F.regexp_replace("value", r"^aisc:@", "").alias("path")).where(F.col("path").startswith("blobs/")).distinct()
    paths = blobs.select("path").distinct()
    lost = paths.join(named, "path", "left_anti").withColumn("side", F.lit("body"))
    return lost.unionByName(named.join(paths, "path", "left_anti").withColumn("side", F.lit("record")))


def stale_postings(postings: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, id, n): entries without a record, or entered more than once."""
    n = postings.groupBy("key", "id").agg(F.count(F.lit(1)).alias("n"))
    ids = lines.select("id").distinct().withColumn("there", F.lit(True))
    return n.join(ids, "id", "left").where("there IS NULL OR n > 1").select("key", "id", "n")
