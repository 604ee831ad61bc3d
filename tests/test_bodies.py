"""Bodies whose paths begin alike."""

import hashlib

from keyloom.operators import upsert as U


def alike():
    """Two texts of two lines whose digests have the same first eight digits."""
    seen = {}
    for n in range(10_000_000):
        text = f"a\n{n}"
        tag = hashlib.md5(text.encode()).hexdigest()[:8]
        if tag in seen:
            return seen[tag], text
        seen[tag] = text


def test_different_bodies_under_one_tag_are_kept_apart(spark, tmp_path):
    a, b = alike()
    rows = [(1, a), (2, b), (3, a), (4, "one line"), (5, "c\nd"), (6, None), (7, " \n ")]
    split = U.placed_documents(U.split_documents(spark.createDataFrame(rows, "seq long, value string").selectExpr("seq", "value", "'2024' AS ts")))
    U.write_bodies(split, f"{tmp_path}/bodies")
    bodies = spark.read.parquet(f"{tmp_path}/bodies")
    assert bodies.count() == 3
    found = {r.seq: (r.value, r.body) for r in U.with_bodies(split.select("seq", "value"), bodies).collect()}
    assert {k: v[1] for k, v in found.items()} == {1: a, 2: b, 3: a, 4: None, 5: "c\nd", 6: None, 7: None}
    assert found[4][0] == "one line" and sorted([found[1][0][-6:], found[2][0][-6:]])[0] == "-2.txt" and found[1][0] == found[3][0]
