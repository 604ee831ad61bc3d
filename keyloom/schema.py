"""Schemas of the record model."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

#: One link of a record: the first by ord is the record itself, later ones are further links.
LINES = "id long, ts string, keys array<string>, value string, ord long"
TOMB = "id long, ts string, hash string, ord long"
KEY_FACTS = "id long, ts string, hash string, key string, ord long"
CLOCK = "id long, ts string"
FACTS = "replica string, seq long, verb string, ts string, hash string, key string, keys array<string>, value string"
TRIALS = (
    "qid string, arm string, root string, root_files long, root_bytes long, repeat int, total_tokens long, in_tokens long, "
    "out_tokens long, retrieval_tokens long, tool_calls int, latency_ms double, correct string, recall double"
)
QUESTIONS = "id string, question string, expect array<string>"


class State(NamedTuple):
    """A keyed index as tables: records, record and key tombstones, key attachments, edit and survival clocks."""

    lines: DataFrame
    tomb: DataFrame
    ktomb: DataFrame
    katt: DataFrame
    mts: DataFrame
    sts: DataFrame


def empty_state(spark) -> State:
    kinds = (LINES, TOMB, KEY_FACTS, KEY_FACTS, CLOCK, CLOCK)
    return State(*(spark.createDataFrame([], k) for k in kinds))
