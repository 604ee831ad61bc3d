"""Readers of stores, fact streams, bundles and tables. Parsers take a column of lines and also serve streams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import key_encode, looks_like_ts, tokenise_keys
from ..schema import QUESTIONS, TRIALS

# Fixed values of the bundle format.
MAGIC, VERSION, HEAD_BYTES = b"AISB", 1, 33
FULL_DATE = r"^[A-Z][A-Z0-9]{0,2}\|\d{4}-\d{2}-\d{2}T"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(line, ord): lines parted by LF alone, with a number that grows along each file."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("ord"))


def parse_lines(rows: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of stored lines: id|ts|keys|value, or id|keys|value where the second field is no date.

    A line without a bar, or whose leading integer isn't above 0, is rejected. CR and LF at the end go; a value keeps its own bars;
    fields that are not there are empty.
    """
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    parts = F.split(bare, r"\|", 3)
    second, rest = (F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in (1, 2))
    dated = looks_like_ts(second)
    tail = F.split(rest, r"\|", 2)
    number = F.regexp_extract(parts[0], r"^\s*([+-]?\d+)", 1).try_cast("long")
    parsed = rows.select(
        "*",
        number.alias("id"),
        F.when(dated, second).otherwise("").alias("ts"),
        tokenise_keys(F.when(dated, tail[0]).otherwise(second)).alias("keys"),
        F.when(dated, F.coalesce(F.get(tail, F.lit(1)), F.lit(""))).otherwise(rest).alias("value"),
        (F.coalesce((F.size(parts) > 1) & (number > 0), F.lit(False))).alias("good"),
    )
    return parsed.where("good").select("id", "ts", "keys", "value", "ord"), parsed.where("NOT good").select(line)


def parse_tomb(rows: DataFrame, line: str = "line") -> DataFrame:
    parts = F.split(F.col(line), r"\|", 3)
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    return rows.select(parts[0].try_cast("long").alias("id"), at(1).alias("ts"), at(2).alias("hash"), "ord").where("id > 0")


def parse_key_facts(rows: DataFrame, line: str = "line") -> DataFrame:
    """id|ts|hash|key, or id|key; anything else is left out."""
    parts = F.split(F.col(line), r"\|", 4)
    n = F.size(parts)
    at = lambda i: F.get(parts, F.lit(i))
    full = n == 4
    out = rows.where(full | (n == 2)).select(
        parts[0].try_cast("long").alias("id"),
        F.when(full, at(1)).otherwise("").alias("ts"),
        F.when(full, at(2)).otherwise("").alias("hash"),
        F.when(full, at(3)).otherwise(at(1)).alias("key"),
        "ord",
    )
    return out.where("id > 0 AND key <> ''")


def read_clock(spark: SparkSession, path: str) -> DataFrame:
    return parse_clocks(spark.read.format("binaryFile").load(path))


def parse_clocks(files: DataFrame) -> DataFrame:
    """(path, id, ts) of clock files (path, content): slots of 20 characters and LF, slot k for id k; blank or malformed slots, or files, have none."""
    size = F.octet_length("content")
    files = files.withColumn("length", size).where("length % 21 = 0 AND length > 0")
    slots = files.select("path", F.posexplode(F.sequence(F.lit(0), (F.col("length") / 21 - 1).cast("int"))).alias("id", "k"), "content")
    ts = F.expr("try_cast(substring(content, k * 21 + 1, 20) AS string)")
    return slots.select("path", F.col("id").cast("long"), ts.alias("ts")).where("id > 0").where(looks_like_ts(F.col("ts")))


def is_quarantined(line: Column) -> Column:
    """A verb that is not known yet, told by the full date behind it."""
    verb = F.regexp_extract(line, r"^([A-Z0-9]+)\|", 1)
    return line.rlike(FULL_DATE) & ~verb.isin("A", "C", "D", "K", "T", "M", "B")


def parse_facts(rows: DataFrame, import_time: str, line: str = "line") -> DataFrame:
    """Rows with verb, ts, hash, key, keys, value and status: fact, skip (blank or comment), unknown (quarantined) or plain.

    An addition without a time is of import_time.
    """
    text = F.col(line)
    verb = F.regexp_extract(text, r"^([ACDKTM])\|", 1)
    four, three = F.split(text, r"\|", 4), F.split(text, r"\|", 3)
    at = lambda parts, i: F.get(parts, F.lit(i))
    enough = (
        F.when(verb == "A", F.size(four) == 4)
        .when(verb.isin("K", "T"), F.size(four) == 4)
        .when(verb.isin("C", "D", "M"), F.size(three) == 3)
        .otherwise(False)
    )
    status = F.when(F.trim(text) == "", "skip").when(text.startswith("#"), "skip").when(enough, "fact").when(is_quarantined(text), "unknown").otherwise("plain")
    out = rows.withColumn("status", status)
    fact = F.col("status") == "fact"
    v = F.when(fact, verb)
    return out.select(
        *rows.columns,
        "status",
        v.alias("verb"),
        F.when(v == "A", F.when(four[1] == "", F.lit(import_time)).otherwise(four[1])).when(v.isin("C", "D", "K", "T"), four[1]).alias("ts"),
        F.when(v.isin("C", "D"), at(three, 2)).when(v.isin("K", "T"), at(four, 2)).when(v == "M", three[1]).alias("hash"),
        F.when(v.isin("K", "T"), at(four, 3)).alias("key"),
        F.when(v == "A", tokenise_keys(at(four, 2))).alias("keys"),
        F.when(v == "A", at(four, 3)).when(v == "M", at(three, 2)).alias("value"),
    )


def parse_kv(line: Column) -> Column:
    """struct<keys, value> of KEY... -v VALUE; null without a marker at a token's start. The value is the rest, verbatim."""
    shape = r"(?s)^(.*?)(?:^|(?<=[ \t]))(?:-v |--value )(.*)$"
    has = line.rlike(shape)
    keys = tokenise_keys(F.rtrim(F.regexp_extract(line, shape, 1)))
    return F.when(has, F.struct(keys.alias("keys"), F.regexp_extract(line, shape, 2).alias("value")))


def parse_legacy_kv(line: Column) -> Column:
    """struct<keys, value, noisy> of keys|value or id|keys|value; null without a bar. A number in front becomes a key."""
    parts = F.split(line, r"\|", 3)
    three = (F.size(parts) == 3) & parts[0].rlike("^[0-9]+$")
    keys = F.when(three, F.concat(F.array(parts[0]), tokenise_keys(F.get(parts, F.lit(1))))).otherwise(tokenise_keys(parts[0]))
    value = F.when(three, F.get(parts, F.lit(2))).otherwise(F.regexp_extract(line, r"(?s)^[^|]*\|(.*)$", 1))
    return F.when(F.size(parts) > 1, F.struct(keys.alias("keys"), value.alias("value"), three.alias("noisy")))


def feed_values(lines: Column) -> Column:
    """The value of a fed line: without CR; blank lines have none."""
    bare = F.regexp_replace(lines, r"\r+$", "")
    return F.when(F.trim(bare) != "", bare)


def from_table(df: DataFrame, id: Column, keys: list[Column], value: Column, ts: Column | None = None) -> DataFrame:
    """Any table as lines: chosen columns become facet keys, a value and a time."""
    coded = F.filter(F.array(*[key_encode(k.cast("string")) for k in keys]), lambda k: k.isNotNull() & (k != ""))
    when = F.lit("") if ts is None else F.coalesce(ts, F.lit(""))
    return df.select(id.cast("long").alias("id"), when.alias("ts"), F.array_distinct(coded).alias("keys"), value.alias("value"), F.lit(0).cast("long").alias("ord"))


def check_bundles(files: DataFrame) -> DataFrame:
    """(path, status, nonce, seq, payload) of binary files (path, content): ok, newer or damaged.

    Frame: magic, version, 16 bytes of nonce, sequence number (8), length (4), crc32 of the payload (4); then the payload.
    """
    number = lambda at, n: F.conv(F.hex(F.substring("content", at, n)), 16, 10).cast("decimal(20,0)").cast("long")
    size = F.octet_length("content")
    payload = F.expr(f"substring(content, {HEAD_BYTES + 5})")
    ours = F.substring("content", 1, 4) == F.lit(bytearray(MAGIC))
    whole = (number(30, 4) == F.octet_length(payload)) & (number(34, 4) == F.crc32(payload))
    status = F.when((size < HEAD_BYTES + 4) | ~ours, "damaged").when(number(5, 1) > VERSION, "newer").when(whole, "ok").otherwise("damaged")
    out = files.withColumn("status", status)
    ok = F.col("status") == "ok"
    return out.select("path", "status", F.when(ok, F.hex(F.substring("content", 6, 16))).alias("nonce"), F.when(ok, number(22, 8)).alias("seq"), F.when(ok, payload).alias("payload"))


def frame_bundle(nonce: bytes, seq: int, payload: bytes) -> bytes:
    """One bundle's bytes."""
    return MAGIC + bytes([VERSION]) + nonce[:16].ljust(16, b"\0") + struct.pack(">QII", seq, len(payload), zlib.crc32(payload)) + payload


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    return check_bundles(spark.read.format("binaryFile").option("pathGlobFilter", "*.aisb").load(path).select("path", "content"))


def container_kind(content: Column) -> Column:
    """bundle, reject (an unknown control byte first) or stream."""
    first = F.conv(F.hex(F.substring(content, 1, 1)), 16, 10).cast("int")
    return F.when(first == 1, "bundle").when((first < 32) & ~first.isin(9, 10, 13), "reject").otherwise("stream")


def latest_bundles(bundles: DataFrame) -> DataFrame:
    """(nonce, seq, payload): the latest valid bundle of each device."""
    return bundles.where("status = 'ok'").groupBy("nonce").agg(F.max_by(F.struct("seq", "payload"), F.struct("seq", "path")).alias("b")).select("nonce", "b.seq", "b.payload")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.concat(F.lit("blobs/"), F.col("_metadata.file_name")).alias("path"), "content", "length")


def embedded_bodies(payloads: DataFrame) -> DataFrame:
    """(nonce, path, content) of the length-prefixed bodies B|path|size in each payload (nonce, payload)."""

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for nonce, payload in zip(frame["nonce"], frame["payload"], strict=True):
                at = 0
                while (end := payload.find(b"\n", at)) >= 0:
                    parts = payload[at:end].split(b"|")
                    at = end + 1
                    if parts[0] == b"B" and len(parts) == 3 and parts[2].isdigit():
                        size = int(parts[2])
                        rows.append((nonce, parts[1].decode("utf-8", "replace"), payload[at : at + size]))
                        at += size + (payload[at + size : at + size + 1] == b"\n")
            yield pd.DataFrame(rows, columns=["nonce", "path", "content"])

    return payloads.select("nonce", "payload").mapInPandas(take, "nonce string, path string, content binary")


def payload_lines(payloads: DataFrame) -> DataFrame:
    """(replica, seq, line) of the fact lines of payloads (nonce, payload) without bodies."""
    text = F.split(F.col("payload").cast("string"), "\n")
    rows = payloads.select(F.col("nonce").alias("replica"), F.posexplode(text).alias("at", "line"))
    return rows.select("replica", F.col("at").cast("long").alias("seq"), "line").where("line <> ''")


def read_index_tree(spark: SparkSession, path: str) -> DataFrame:
    """(key, value): a key's name is its file's, each line a value; blank lines and comments go."""
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    value = F.trim(F.col("value"))
    return rows.select(F.col("_metadata.file_name").alias("key"), value.alias("value")).where((value != "") & ~value.startswith("#"))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=TRIALS, header=True)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return parse_questions(spark.read.schema(QUESTIONS.replace("array<string>", "string")).json(path, multiLine=True))


def parse_questions(raw: DataFrame) -> DataFrame:
    """Questions whose expectation is a string or a list."""
    listed = F.from_json("expect", "array<string>")
    return raw.withColumn("expect", F.when(F.col("expect").startswith("["), listed).when(F.col("expect") != "", F.array("expect")).otherwise(F.array().cast("array<string>")))


def read_tool_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tool string, chars long, latency_ms double").json(path)


def read_corpus(spark: SparkSession, path: str, excluded: list[str]) -> DataFrame:
    """(path, text) of the lines of a tree without excluded folders."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for name in excluded:
        rows = rows.where(~F.col("path").contains(f"/{name}/"))
    return rows
