"""Synthetic index data with Zipf-distributed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def zipf_index(rows: DataFrame, id: str, *, words: int = 4000, exponent: float = 1.1, two: float = 0.8, seed: int = 20260606, years: int = 30) -> DataFrame:
    """(id, ts, keys, value, ord): for each row one or (with probability two) two distinct keys of a Zipf vocabulary.

    All draws are hashes of the id, so a rerun gives the same index however rows are dealt; times don't decrease with the id.
    The vocabulary has `words` entries and goes to all tasks as one array of cumulative weights.
    """
    spark: SparkSession = rows.sparkSession
    total, bounds = 0.0, []
    for k in range(1, words + 1):
        total += 1 / k**exponent
        bounds.append(total)
    cumulative = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda k: F.pow(k.cast("double"), F.lit(-exponent))).alias("w"))
    cumulative = cumulative.select(F.posexplode("w").alias("k", "w")).withColumn("hi", F.sum("w").over(Window.orderBy("k")) / total)
    # A draw's slot of 1/4096 holds the few words whose range meets it, which makes the range join an equi-join.
    slots = cumulative.withColumn("lo", F.col("hi") - F.col("w") / total)
    slots = slots.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") * 4096), F.least(F.floor(F.col("hi") * 4096), F.lit(4095)))))
    draw = lambda n: F.pmod(F.xxhash64(id, F.lit(seed), F.lit(n)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    last = rows.agg(F.max(id)).first()[0] or 1
    step = years * 365 * 86400 / (last + 1)
    at = F.timestamp_seconds((F.lit(631152000) + F.col(id) * step + draw(3) * step).cast("long"))
    one = rows.select(id, F.explode(F.when(draw(0) < two, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("turn"), at.alias("at"))
    one = one.withColumn("u", F.when(F.col("turn") == 1, draw(1)).otherwise(draw(2))).withColumn("slot", F.floor(F.col("u") * 4096))
    met = one.join(F.broadcast(slots), "slot").where("u >= lo AND u < hi")
    keys = met.groupBy(id, "at").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "k"))), lambda s: F.concat(F.lit("w"), s["k"].cast("string")))).alias("keys"))
    value = F.concat(F.lit("item/"), F.col(id).cast("string"))
    return keys.select(F.col(id).cast("long").alias("id"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "keys", value.alias("value"), F.lit(0).cast("long").alias("ord"))
