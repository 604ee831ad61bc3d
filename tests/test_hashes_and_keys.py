"""The content hash and the encoded key against plain loops, and what their speed is for."""

import random
import time

from pyspark.sql import functions as F

from keyloom.functions.text import BLANKED, KEY_BYTES, LOWER, UPPER, content_hash, key_encode


def plain_hash(value):
    h = 1469598103934665603
    for b in value.encode():
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return f"{h:016x}"


def plain_key(key):
    key = key.translate(str.maketrans(UPPER + BLANKED, LOWER + "_" * len(BLANKED)))
    key = "_" + key[1:] if key.startswith(".") else key
    return key.encode()[:KEY_BYTES].decode(errors="ignore")


def texts():
    pick = random.Random(3)
    some = ["".join(pick.choice("aZ.|/\\ \t\x00\x7fßÉ漢😀\n-[]{}~!_Kİ") for _ in range(pick.randint(1, 9))) for _ in range(3000)]
    return ["", ".", "..", "A\n", "a" * 511, "A" * 512, "é" * 256, "x" * 510 + "é", "w" * 70_000, *some]


def test_hash_and_key_equal_plain_loops(spark):
    rows = spark.createDataFrame([(t,) for t in texts()], "v string").repartition(3)
    for v, h, k in rows.select("v", content_hash(F.col("v")), key_encode(F.col("v"))).collect():
        assert h == plain_hash(v) and k == plain_key(v)
    assert spark.sql("SELECT CAST(NULL AS string) AS v").select(content_hash(F.col("v")), key_encode(F.col("v"))).first() == (None, None)


def test_hash_takes_no_evaluation_for_each_byte(spark):
    rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("v"), "id")
    best = []
    for _ in range(3):
        start = time.time()
        rows.select(F.max(content_hash(F.concat("v", F.col("id").cast("string"))))).collect()
        best.append(time.time() - start)
    assert min(best) < 1.5
