"""The driver's tables as records, postings, facts and trials, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LOWER, UPPER, key_encode
from ..operators import views
from ..operators.index import Index, write_index
from ..schema import State
from ..scratch import fresh
from ..session import table
from ..sources.readers import from_table

ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Tombstones' and key tombstones' time.
DELETED = "2020-01-01T00:00:00Z"


def orders_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as records; every fifth id has a second link."""
    o = table(spark, sf, "orders")
    at = F.col("o_orderdate")
    keys = [F.col("o_orderstatus"), F.col("o_orderpriority"), F.date_format(at, "yyyy"), F.date_format(at, "yyyy-MM")]
    base = from_table(o, F.col("o_orderkey") + 1, keys, F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")), F.date_format(at, ISO))
    more = base.where("id % 5 = 0").withColumn("value", F.concat("value", F.lit("/copy"))).withColumn("ord", F.lit(1).cast("long"))
    return base.unionByName(more)


def orders_state(spark: SparkSession, sf: str) -> State:
    """Orders with tombstones for every 17th id, and the first key of every 11th detached."""
    lines = orders_lines(spark, sf)
    base = lines.where("ord = 0")
    tomb = base.where("id % 17 = 0").select("id", F.lit(DELETED).alias("ts"), F.when(F.col("id") % 34 == 0, F.col("value")).otherwise("").alias("hash"), F.col("id").alias("ord"))
    first = base.where("id % 11 = 0").select("id", F.lit(DELETED).alias("ts"), F.when(F.col("id") % 22 == 0, F.col("value")).otherwise("").alias("hash"), F.col("keys")[0].alias("key"), F.col("id").alias("ord"))
    katt = base.where("id % 13 = 0").select("id", F.lit("2021-01-01T00:00:00Z").alias("ts"), F.col("value").alias("hash"), F.col("keys")[1].alias("key"), F.col("id").alias("ord"))
    mts = base.where("id % 7 = 0").select("id", F.lit("2022-01-01T00:00:00Z").alias("ts"))
    sts = base.where("id % 19 = 0").select("id", F.lit("2019-01-01T00:00:00Z").alias("ts"))
    return State(lines, tomb, first, katt, mts, sts)


_INDEXES: dict[tuple, Index] = {}


def orders_index(spark: SparkSession, sf: str) -> Index:
    """The stored index of orders_state; it is written once for the files that there are and then read by all queries of the session."""
    files = table(spark, sf, "orders").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size")
    mark = files.agg(F.max("file_modification_time"), F.count(F.lit(1)), F.max("file_size")).first()
    key = (spark.sparkContext.applicationId, sf, *mark)
    if key not in _INDEXES:
        _INDEXES[key] = write_index(orders_state(spark, sf), fresh(spark, "index"))
    return _INDEXES[key]


def orders_shown(spark: SparkSession, sf: str) -> DataFrame:
    s = orders_state(spark, sf)
    return views.shown(s.lines, s.tomb, s.ktomb)


def orders_postings(spark: SparkSession, sf: str) -> DataFrame:
    return views.postings(orders_shown(spark, sf))


def parts_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as undated records under brand, type and size."""
    keys = [F.col("p_brand"), F.col("p_type"), F.concat(F.lit("size_"), F.col("p_size").cast("string"))]
    return from_table(table(spark, sf, "part"), F.col("p_partkey") + 1, keys, F.concat(F.lit("part/"), F.col("p_partkey").cast("string")))


def parts_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, value, keys, ts): part names, which repeat, as values to be put."""
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("value"), F.array("p_brand", "p_type").alias("keys"), F.lit("").alias("ts"))


def event_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as facts of four replicas; a user is a record whose hash is its value."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    verb = F.when(kind.isin("signup", "purchase"), "A").when(kind == "view", "T").when(kind == "click", "K").otherwise("D")
    key = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    out = e.select(
        (F.col("event_id") % 4).cast("string").alias("replica"), F.col("event_id").alias("seq"), verb.alias("verb"),
        F.date_format("ts", ISO).alias("ts"), user.alias("hash"), key.alias("k"),
    )
    return out.select("replica", "seq", "verb", "ts", "hash", F.when(F.col("verb").isin("K", "T"), F.col("k")).alias("key"), F.when(F.col("verb") == "A", F.array("k")).alias("keys"), F.when(F.col("verb") == "A", F.col("hash")).alias("value"))


def linked_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Event facts of one replica per user in which every fifth user's next is a further link of it."""
    facts = event_facts(spark, sf)
    user = F.substring("hash", 6, 20).cast("long")
    links = facts.where("verb = 'A'").where(user % 5 == 1).select("replica", "seq", F.lit("M").alias("verb"), F.lit(None).cast("string").alias("ts"), F.concat(F.lit("user/"), (user - 1).cast("string")).alias("hash"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("array<string>").alias("keys"), "value")
    return facts.unionByName(links)


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as trials: a question per conversation modulo 8, roles as arms, lengths as tokens."""
    c = table(spark, sf, "conversations")
    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    arm = F.when(F.col("role") == "user", "index").otherwise("search")
    root = F.concat(F.lit("root"), (F.col("turn") % 3).cast("string"))
    right = F.when(F.col("conv_id") % 7 == 0, "").when((n + F.col("turn")) % 3 == 0, "False").otherwise("True")
    return c.select(
        F.concat(F.lit("q"), (F.col("conv_id") % 8).cast("string")).alias("qid"), arm.alias("arm"), root.alias("root"),
        (F.col("turn") % 3 * 100 + 10).cast("long").alias("root_files"), (F.col("turn") % 3 * 1000 + 7).cast("long").alias("root_bytes"),
        F.col("turn").cast("int").alias("repeat"), n.alias("total_tokens"), F.floor(n / 2).alias("in_tokens"), F.floor(n / 3).alias("out_tokens"),
        F.floor(n / 4).alias("retrieval_tokens"), (F.col("turn") % 4).cast("int").alias("tool_calls"), (n % 997).cast("double").alias("latency_ms"),
        right.alias("correct"), (F.col("conv_id") % 5 / 4).alias("recall"),
    )


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(path, line, text): every line of every document."""
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    return d.select(path.alias("path"), "text")


# ---- the same as SQL ----


def ek(x: str) -> str:
    return f"regexp_replace(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[\\x00-\\x20\\x7F|/\\\\]', '_', 'g'), '^\\.', '_')"


ORDERS = f"""
base AS (SELECT o_orderkey + 1 AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts,
  [{ek("o_orderstatus")}, {ek("o_orderpriority")}, strftime(o_orderdate, '%Y'), strftime(o_orderdate, '%Y-%m')] AS keys,
  'order/' || o_orderkey AS value, 0::BIGINT AS ord FROM orders),
lines AS (SELECT * FROM base UNION ALL SELECT id, ts, keys, value || '/copy', 1::BIGINT FROM base WHERE id % 5 = 0),
tomb AS (SELECT id, '{DELETED}' AS ts, CASE WHEN id % 34 = 0 THEN value ELSE '' END AS hash, id AS ord FROM base WHERE id % 17 = 0),
ktomb AS (SELECT id, '{DELETED}' AS ts, CASE WHEN id % 22 = 0 THEN value ELSE '' END AS hash, keys[1] AS key, id AS ord FROM base WHERE id % 11 = 0),
katt AS (SELECT id, '2021-01-01T00:00:00Z' AS ts, value AS hash, keys[2] AS key, id AS ord FROM base WHERE id % 13 = 0),
mts AS (SELECT id, '2022-01-01T00:00:00Z' AS ts FROM base WHERE id % 7 = 0),
sts AS (SELECT id, '2019-01-01T00:00:00Z' AS ts FROM base WHERE id % 19 = 0),
live AS (SELECT * FROM lines WHERE id NOT IN (SELECT id FROM tomb)),
shown AS (SELECT l.id, l.ts, list_filter(l.keys, lambda k: k IS DISTINCT FROM t.key) AS keys, l.value, l.ord FROM live l LEFT JOIN ktomb t ON l.id = t.id),
firsts AS (SELECT *, count(*) OVER (PARTITION BY id) - 1 AS extra FROM shown QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1),
postings AS (SELECT DISTINCT unnest(keys) AS key, id FROM firsts)
"""
WITH_ORDERS = "WITH " + ORDERS

WITH_PARTS = f"""WITH parts AS (SELECT p_partkey + 1 AS id, [{ek("p_brand")}, {ek("p_type")}, 'size_' || p_size] AS keys, 'part/' || p_partkey AS value FROM part)
"""

FACTS = """
facts0 AS (SELECT (event_id % 4)::VARCHAR AS replica, event_id AS seq,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'A' WHEN event_type = 'view' THEN 'T' WHEN event_type = 'click' THEN 'K' ELSE 'D' END AS verb,
  strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'user/' || user_id AS hash, 'k' || ((props->>'$.k')::INT % 7) AS k FROM events),
facts AS (SELECT replica, seq, verb, ts, hash, CASE WHEN verb IN ('K', 'T') THEN k END AS key, CASE WHEN verb = 'A' THEN k END AS akey, CASE WHEN verb = 'A' THEN hash END AS value FROM facts0)
"""
#: facts, and the records and keys that they converge to. {rec} is what names a fact's record.
CONVERGED = """
recs AS (SELECT hash AS rec, max(value) AS value, max(ts) FILTER (verb = 'A') AS add_ts, max(ts) FILTER (verb = 'D') AS del_ts FROM facts GROUP BY hash),
records AS (SELECT *, add_ts IS NOT NULL AND coalesce(add_ts > del_ts, true) AS live FROM recs),
told AS (SELECT f.hash AS rec, f.verb, f.ts, coalesce(f.akey, f.key) AS key FROM facts f JOIN records r ON f.hash = r.rec
  WHERE r.live AND f.verb IN ('A', 'K', 'T') AND (f.verb = 'K' OR coalesce(f.ts > r.del_ts, true))),
times AS (SELECT rec, key, max(ts) FILTER (verb IN ('A', 'T')) AS att, max(ts) FILTER (verb = 'K') AS det FROM told GROUP BY rec, key),
reckeys AS (SELECT rec, key FROM times WHERE att IS NOT NULL AND coalesce(att > det, true))
"""
WITH_FACTS = "WITH " + FACTS
WITH_CONVERGED = "WITH " + FACTS + "," + CONVERGED

TRIALS = """trials0 AS (SELECT *, coalesce(strlen(text), 0) AS n FROM conversations),
trials AS (SELECT 'q' || (conv_id % 8) AS qid, CASE WHEN role = 'user' THEN 'index' ELSE 'search' END AS arm, 'root' || (turn % 3) AS root,
  turn % 3 * 100 + 10 AS root_files, turn % 3 * 1000 + 7 AS root_bytes, turn AS repeat, n AS total_tokens, n // 4 AS retrieval_tokens, (n % 997)::DOUBLE AS latency_ms,
  CASE WHEN conv_id % 7 = 0 THEN '' WHEN (n + turn) % 3 = 0 THEN 'False' ELSE 'True' END AS correct, conv_id % 5 / 4 AS recall FROM trials0)
"""
WITH_TRIALS = "WITH " + TRIALS

#: The content hash of value.
FNV = "lpad(lower(hex(list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(range(1, length(value) + 1), lambda i: ascii(substr(value, i, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT)), 16, '0')"
