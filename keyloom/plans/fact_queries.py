"""Replication queries and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as X
from ..operators import generate
from ..operators import merge as M
from ..operators import replicas as R
from ..scratch import fresh
from ..session import table
from ..streaming import stateful, streams
from . import tables as T
from .registry import query

W = T.WITH_ORDERS


def itself(col):
    """Records of these tables are named by their values."""
    return col


@query(W + "SELECT f.id, f.ts AS true_ts, greatest(f.ts, coalesce(s.ts, '')) AS ts, array_to_string(f.keys, ' ') AS keys, f.value FROM firsts f LEFT JOIN sts s USING (id)")
def export_a(spark, sf):
    return X.export_a(T.orders_state(spark, sf)).select("id", "true_ts", "ts", F.array_join("keys", " ").alias("keys"), "value")


@query(W + "SELECT f.id, f.ts AS true_ts FROM firsts f JOIN sts s USING (id) WHERE s.ts > f.ts")
def export_c(spark, sf):
    return X.export_c(X.export_a(T.orders_state(spark, sf))).select("id", "true_ts")


@query(W + "SELECT s.id, b.value AS head, s.value FROM shown s JOIN base b USING (id) WHERE s.ord > 0")
def export_m(spark, sf):
    return X.export_m(T.orders_state(spark, sf))


@query(W + "SELECT 'D' AS verb, ts, hash, NULL AS key FROM tomb WHERE hash <> '' UNION ALL SELECT 'K', ts, hash, key FROM ktomb WHERE hash <> '' UNION ALL SELECT 'T', ts, hash, key FROM katt WHERE hash <> ''")
def export_dkt(spark, sf):
    return X.export_dkt(T.orders_state(spark, sf))


@query(W + "SELECT section, verb, count(*) AS n FROM (SELECT 0 AS section, 'A' AS verb FROM firsts UNION ALL SELECT 0, 'C' FROM firsts f JOIN sts s USING (id) WHERE s.ts > f.ts UNION ALL SELECT 0, 'M' FROM shown WHERE ord > 0 UNION ALL SELECT 1, 'D' FROM tomb WHERE hash <> '' UNION ALL SELECT 2, 'K' FROM ktomb WHERE hash <> '' UNION ALL SELECT 3, 'T' FROM katt) GROUP BY ALL")
def export_sections(spark, sf):
    return X.export(T.orders_state(spark, sf)).groupBy("section", "verb").agg(F.count(F.lit(1)).alias("n"))


@query(T.WITH_CONVERGED + "SELECT rec, value, add_ts, del_ts, live FROM records")
def converge_records(spark, sf):
    return M.converge(T.event_facts(spark, sf), itself).records


@query(T.WITH_CONVERGED + "SELECT rec, key FROM reckeys")
def converge_keys(spark, sf):
    return M.converge(T.event_facts(spark, sf), itself).keys


_LINKED = "WITH " + T.FACTS + """, links AS (SELECT DISTINCT hash AS link, 'user/' || (substr(hash, 6)::BIGINT - 1) AS head FROM facts WHERE verb = 'A' AND substr(hash, 6)::BIGINT % 5 = 1),
res AS (SELECT f.verb, coalesce(l.head, f.hash) AS rec FROM facts f LEFT JOIN links l ON f.hash = l.link) """


@query(_LINKED + "SELECT rec, verb, count(*) AS n FROM res GROUP BY rec, verb")
def link_resolution(spark, sf):
    facts = X.resolved(T.linked_facts(spark, sf), itself)
    return facts.where("verb <> 'M'").groupBy("rec", "verb").agg(F.count(F.lit(1)).alias("n"))


@query(W + """, c AS (SELECT b.id, b.ts AS line_ts, strftime(strptime(b.ts, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL (b.id % 3 - 1) DAY, '%Y-%m-%dT%H:%M:%SZ') AS del_ts, strftime(strptime(b.ts, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL (b.id % 4 - 1) DAY, '%Y-%m-%dT%H:%M:%SZ') AS edit_ts, s.ts AS sts FROM base b LEFT JOIN sts s USING (id)),
r AS (SELECT *, least(strftime(strptime(del_ts, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ'), edit_ts) AS up FROM c) SELECT id, CASE WHEN edit_ts > del_ts AND up > line_ts AND up > coalesce(sts, '') THEN up END AS raised FROM r""")
def survival_raise(spark, sf):
    s = T.orders_state(spark, sf)
    base = s.lines.where("ord = 0").join(s.sts.select("id", F.col("ts").alias("sts")), "id", "left")
    at = F.to_timestamp("ts", T.ISO)
    shift = lambda m: F.date_format(at + F.make_dt_interval(days=(F.col("id") % m - 1).cast("int")), T.ISO)
    return base.select("id", X.survival_raise(shift(3), shift(4), F.col("ts"), F.col("sts")).alias("raised"))


@query("WITH " + T.FACTS + "SELECT DISTINCT verb, hash, key, akey AS keys, ts, value FROM (SELECT * FROM facts UNION ALL SELECT * FROM facts WHERE seq % 3 = 0)")
def fact_dedupe(spark, sf):
    f = T.event_facts(spark, sf)
    return X.distinct_facts(f.unionByName(f.where("seq % 3 = 0"))).select("verb", "hash", "key", F.array_join("keys", " ").alias("keys"), "ts", "value")


_CLOCKED = """WITH f AS (SELECT event_id % 4 AS r, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'A' ELSE 'D' END AS verb, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'u' || (user_id % 2) AS hash FROM events),
p AS (SELECT *, lag(verb) OVER w AS pv, lag(ts) OVER w AS pt, lag(hash) OVER w AS ph FROM f WHERE verb IN ('A', 'C') WINDOW w AS (PARTITION BY r ORDER BY seq)) """


@query(_CLOCKED + "SELECT seq, CASE WHEN pv = 'C' AND ph = hash THEN pt ELSE ts END AS true_ts FROM p WHERE verb = 'A'")
def true_times(spark, sf):
    e = table(spark, sf, "events")
    verb = F.element_at(F.array(F.lit("C"), F.lit("A"), F.lit("D")), (F.col("event_id") % 3 + 1).cast("int"))
    f = e.select((F.col("event_id") % 4).cast("string").alias("replica"), F.col("event_id").alias("seq"), verb.alias("verb"), F.date_format("ts", T.ISO).alias("ts"), F.concat(F.lit("u"), (F.col("user_id") % 2).cast("string")).alias("hash"))
    return X.true_times(f).where("verb = 'A'").select("seq", "true_ts")


_PLACED = """WITH b AS (SELECT (doc_id % 3)::VARCHAR AS replica, 'blobs/' || (doc_id % 200) || '.txt' AS path, md5(text) AS tag FROM documents),
f AS (SELECT path, tag, min(replica) AS by_ FROM b GROUP BY path, tag), h AS (SELECT path, arg_min(tag, by_ || tag) AS held FROM f GROUP BY path),
placed AS (SELECT DISTINCT replica, path, CASE WHEN tag = held THEN path ELSE replace(path, '.txt', '') || '~' || substr(tag, 1, 16) || '.txt' END AS placed FROM b JOIN h USING (path)) """


def _placed(spark, sf):
    d = table(spark, sf, "documents")
    bodies = d.select((F.col("doc_id") % 3).cast("string").alias("replica"), F.concat(F.lit("blobs/"), (F.col("doc_id") % 200).cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("body"))
    return M.place_documents(bodies).distinct()


@query(_PLACED + "SELECT * FROM placed")
def doc_placement(spark, sf):
    return _placed(spark, sf)


_MAPPED = _PLACED + ", one AS (SELECT replica, path, min(placed) AS placed FROM placed GROUP BY replica, path), v AS (SELECT doc_id, (doc_id % 3)::VARCHAR AS replica, CASE WHEN doc_id % 2 = 0 THEN 'aisc:@' ELSE '' END AS mark, 'blobs/' || (doc_id % 400) || '.txt' AS path FROM documents) "


@query(_MAPPED + "SELECT doc_id, v.replica, mark || coalesce(one.placed, v.path) AS value FROM v LEFT JOIN one USING (replica, path)")
def value_remap(spark, sf):
    d = table(spark, sf, "documents")
    value = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("aisc:@")).otherwise(""), F.lit("blobs/"), (F.col("doc_id") % 400).cast("string"), F.lit(".txt"))
    rows = d.select("doc_id", (F.col("doc_id") % 3).cast("string").alias("replica"), value.alias("value"))
    return M.remap_values(rows, _placed(spark, sf).groupBy("replica", "path").agg(F.min("placed").alias("placed")))


@query(T.WITH_FACTS + "SELECT hash AS value, '' AS keys, 'a' AS side FROM facts WHERE false")
def convergence_check(spark, sf):
    """Two replicas that get the facts in other orders end alike: no differences."""
    f = T.event_facts(spark, sf)
    other = f.withColumn("seq", 1_000_000_000 - F.col("seq")).withColumn("replica", F.lit("z"))
    return R.compared(M.normal_state(M.converge(f, itself)), M.normal_state(M.converge(other, itself)))


@query(T.WITH_FACTS + "SELECT hash AS value, '' AS keys, 'a' AS side FROM facts WHERE false")
def idempotence_check(spark, sf):
    f = T.event_facts(spark, sf)
    return R.compared(M.normal_state(M.converge(f, itself)), M.normal_state(M.converge(f.unionByName(f), itself)))


_ENDS = ", ks AS (SELECT rec, string_agg(key, ' ' ORDER BY key) AS keys FROM reckeys GROUP BY rec), state AS (SELECT value, coalesce(keys, '') AS keys FROM records LEFT JOIN ks USING (rec) WHERE live)"
_PART = T.WITH_CONVERGED.replace("FROM events)", "FROM events WHERE event_id % 4 <> 3)") + _ENDS + " SELECT * FROM state"


@query("WITH whole AS (" + T.WITH_CONVERGED + _ENDS + " SELECT * FROM state), part AS (" + _PART + """)
SELECT *, 'a' AS side FROM (SELECT * FROM whole EXCEPT ALL SELECT * FROM part) UNION ALL SELECT *, 'b' FROM (SELECT * FROM part EXCEPT ALL SELECT * FROM whole)""")
def replica_differences(spark, sf):
    """A replica that has not heard of one device yet, against one that has."""
    f = T.event_facts(spark, sf)
    return R.compared(M.normal_state(M.converge(f, itself)), M.normal_state(M.converge(f.where("replica <> '3'"), itself)))


@query(T.WITH_CONVERGED + "SELECT rec, live FROM records")
def late_facts(spark, sf):
    """Facts in the reverse order of their times: liveness is the same."""
    f = T.event_facts(spark, sf).withColumn("seq", -F.col("seq"))
    return M.converge(f, itself).records.select("rec", "live")


@query(T.WITH_CONVERGED + ", ks AS (SELECT rec, string_agg(key, ' ' ORDER BY key) AS keys FROM reckeys GROUP BY rec) SELECT value, coalesce(keys, '') AS keys FROM records LEFT JOIN ks USING (rec) WHERE live")
def converged_state(spark, sf):
    return M.normal_state(M.converge(T.event_facts(spark, sf), itself))


_REPLAY = "WITH RECURSIVE " + T.FACTS + """, f AS (SELECT hash AS rec, verb, coalesce(ts, '') AS ts, row_number() OVER (PARTITION BY hash ORDER BY replica, seq) AS n FROM facts WHERE verb IN ('A', 'D')),
s AS (SELECT rec, 0::BIGINT AS n, false AS seen, false AS live, '' AS ts, '' AS gone FROM f WHERE f.n = 1
  UNION ALL SELECT s.rec, f.n,
    s.seen OR f.verb = 'A',
    CASE WHEN f.verb = 'A' THEN CASE WHEN s.seen AND NOT s.live AND f.ts <= s.gone THEN false ELSE true END WHEN s.seen AND f.ts >= s.ts THEN false ELSE s.live END,
    CASE WHEN f.verb = 'A' AND NOT (s.seen AND NOT s.live AND f.ts <= s.gone) THEN greatest(s.ts, f.ts) ELSE s.ts END,
    CASE WHEN f.verb = 'D' AND s.seen AND f.ts >= s.ts THEN greatest(s.gone, f.ts) ELSE s.gone END
  FROM s JOIN f ON f.rec = s.rec AND f.n = s.n + 1) """


@query(_REPLAY + "SELECT rec, live, ts FROM s WHERE seen QUALIFY row_number() OVER (PARTITION BY rec ORDER BY n DESC) = 1")
def replay_liveness(spark, sf):
    """Records after their facts were applied in order; replay_merge has their keys besides."""
    return M.replay(T.event_facts(spark, sf), itself).select("rec", "live", "ts")


@query()
def replay_merge(spark, sf):
    out = M.replay(T.event_facts(spark, sf), itself)
    return out.select("rec", "live", "ts", F.array_join("keys", " ").alias("keys"))


def _scratch(spark) -> str:
    return fresh(spark, "stream")


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def _event_stream(spark, sf):
    e = _stream(spark, sf, "events")
    kind = F.col("event_type")
    verb = F.when(kind.isin("signup", "purchase"), "A").when(kind == "view", "T").when(kind == "click", "K").otherwise("D")
    key = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))
    user = F.concat(F.lit("user/"), F.col("user_id").cast("string"))
    return e.select((F.col("event_id") % 4).cast("string").alias("replica"), F.col("event_id").alias("seq"), verb.alias("verb"), F.date_format("ts", T.ISO).alias("ts"), user.alias("hash"), F.when(verb.isin("K", "T"), key).alias("key"), F.when(verb == "A", F.array(key)).alias("keys"), F.when(verb == "A", user).alias("value"))


@query(T.WITH_CONVERGED + ", ks AS (SELECT rec, string_agg(key, ' ' ORDER BY key) AS keys FROM reckeys GROUP BY rec) SELECT rec, value, live, coalesce(keys, '') AS keys FROM records LEFT JOIN ks USING (rec)")
def stream_converge(spark, sf):
    path = _scratch(spark)
    q = streams.converge_stream(_event_stream(spark, sf), path, checkpoint=f"{path}/log")
    q.processAllAvailable()
    q.stop()
    return streams.current(spark, path, itself)


@query("SELECT row_number() OVER (ORDER BY value) AS id, value, 'shop parts' AS keys FROM (SELECT DISTINCT p_name AS value FROM part WHERE trim(p_name) <> '')")
def stream_feed(spark, sf):
    path = _scratch(spark)
    q = streams.feed(_stream(spark, sf, "part").select(F.col("p_name").alias("value")), ["shop", "parts"], path, checkpoint=f"{path}/log")
    q.processAllAvailable()
    q.stop()
    return streams.fed(spark, path).select("id", "value", F.array_join("keys", " ").alias("keys"))


@query("WITH " + T.FACTS + "SELECT hash, max(ts) FILTER (verb = 'A') AS add_ts, max(ts) FILTER (verb = 'D') AS del_ts FROM facts GROUP BY hash")
def stream_liveness(spark, sf):
    out = streams.run_once(streams.liveness(_event_stream(spark, sf)), _scratch(spark), "complete")
    return out.select("hash", "add_ts", "del_ts")


@query()
def stream_replay(spark, sf):
    """Facts replayed as they stream by; equal to replay_merge, as all arrive in one batch."""
    out = streams.run_once(stateful.replay_stream(_event_stream(spark, sf), itself), _scratch(spark), "append")
    return out.select("rec", "live", "ts", F.array_join("keys", " ").alias("keys"))


@query("SELECT 'k' || ((props->>'$.k')::INT % 7) AS key, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1")
def stream_tag_counts(spark, sf):
    return streams.run_once(streams.tag_counts(_event_stream(spark, sf).where("verb = 'A'")), _scratch(spark), "complete")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1")
def stream_days(spark, sf):
    rows = _stream(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("at"))
    out = streams.run_once(streams.per_day(rows, "at"), _scratch(spark), "complete")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


@query("WITH " + T.FACTS + "SELECT substr(ts, 1, 10) AS day, hash, max(ts) AS del_ts FROM facts WHERE verb = 'D' GROUP BY 1, 2")
def stream_forgetting(spark, sf):
    """Latest deletes by day, which a running stream keeps for the delay only."""
    rows = _event_stream(spark, sf).withColumn("at", F.to_timestamp("ts", T.ISO))
    out = streams.run_once(streams.forgetting(rows, "at", "30 days"), _scratch(spark), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "hash", "del_ts")


@query("WITH " + T.FACTS + """SELECT hash, seq, CASE WHEN verb = 'D' THEN 'deleted' WHEN gone IS NULL OR ts > gone THEN 'added' ELSE 'refused' END AS status
FROM (SELECT *, max(CASE WHEN verb = 'D' THEN ts END) OVER (PARTITION BY hash ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM facts WHERE verb IN ('A', 'D'))""")
def stream_returns(spark, sf):
    """Additions that a delete refuses; all events are one batch here, so no delete is forgotten yet."""
    rows = _event_stream(spark, sf).withColumn("at", F.to_timestamp("ts", T.ISO))
    return streams.run_once(stateful.forgetting_stream(rows, "at", "1 day", 30 * 86_400_000), _scratch(spark), "append")


@query("WITH " + T.FACTS + "SELECT count(*) AS n FROM (SELECT DISTINCT verb, hash, key, akey, ts, value FROM facts)")
def stream_dedupe(spark, sf):
    rows = _event_stream(spark, sf).withColumn("at", F.to_timestamp("ts", T.ISO))
    out = streams.run_once(streams.without_replays(rows, "at", "3650 days"), _scratch(spark), "append")
    return out.agg(F.count(F.lit(1)).alias("n"))


@query()
def generate_zipf(spark, sf):
    return generate.zipf_index(table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("n")), "n").select("id", "ts", F.array_join("keys", " ").alias("keys"), "value")
