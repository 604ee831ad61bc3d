"""Replicas compared by digests tell what a plain comparison tells."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import merge as M
from keyloom.operators import replicas as R

SCHEMA = "value string, keys string"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ([("x", "k"), ("y", None)], [("y", None), ("x", "k")]),
        ([("x", "k"), ("x", "k"), ("z", "")], [("x", "k"), ("z", None)]),
        ([("x", None)], [(None, "x")]),
        ([], [("x", "k")]),
        ([], []),
        ([("x", "k")] * 3, [("x", "k")] * 5),
    ],
)
def test_same_as_plain(spark, a, b):
    left, right = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    assert rows(R.compared(left, right)) == rows(M.differences(left, right))


def test_only_ranges_that_differ_are_read_further(spark):
    a = spark.range(50_000).select(F.col("id").cast("string").alias("value"), F.lit("k").alias("keys"))
    b = a.where("value <> '777'").unionByName(spark.createDataFrame([("new", "k")], SCHEMA))
    assert R.differing(a, a, 12).count() == 0
    ranges = R.differing(a, b, 12)
    assert 1 <= ranges.count() <= 2 and R.within(a, ranges, 12).count() < 60
    assert {(r.value, r.side) for r in R.compared(a, b).collect()} == {("777", "a"), ("new", "b")}
