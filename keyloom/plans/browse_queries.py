"""Browse queries, validation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import index as X
from ..operators import quality as Q
from ..operators import views
from ..operators.upsert import split_documents
from ..session import table
from ..sources.sinks import dump
from . import tables as T
from .registry import query

W = T.WITH_ORDERS


@query(W + "SELECT id, ord, value FROM shown WHERE contains(value, '99')")
def find_substring(spark, sf):
    return B.find(T.orders_shown(spark, sf), "99").select("id", "ord", "value")


_DOC_LINES = "WITH d AS (SELECT 'docs/' || source || '/' || doc_id AS path, string_split(text, chr(10)) AS ls FROM documents), l AS (SELECT path, unnest(ls) AS text, generate_subscripts(ls, 1)::INT AS line FROM d) "


@query(_DOC_LINES + "SELECT path, line, text FROM l WHERE regexp_matches(text, '(?i)than.*the') ORDER BY path, line LIMIT 200")
def grep_lines(spark, sf):
    return B.grep(B.text_lines(T.doc_lines(spark, sf), "path", "text"), "(?i)than.*the")


@query(_DOC_LINES + "SELECT DISTINCT path FROM d WHERE regexp_matches(path, '^docs/src1[^/]*/[^/]*5$') ORDER BY path LIMIT 300")
def glob_list(spark, sf):
    return B.glob_list(T.doc_lines(spark, sf), "docs/src1*/*5")


@query(W + "SELECT DISTINCT key FROM postings")
def key_vocabulary(spark, sf):
    return B.key_vocabulary(T.orders_postings(spark, sf))


@query(W + "SELECT key, count(*) AS n FROM postings GROUP BY key")
def tags(spark, sf):
    return B.tags(T.orders_index(spark, sf).postings)


@query(W + ", n AS (SELECT key, count(*) AS n FROM postings GROUP BY key) SELECT * FROM n WHERE n < 2000 OR (n = 2000 AND key > 'f') ORDER BY n DESC, key LIMIT 25")
def tags_page(spark, sf):
    return B.tags(T.orders_postings(spark, sf), (2000, "f"), 25)


_TL = W + "SELECT id, ts, array_to_string(keys, ' ') AS keys, value, extra FROM firsts "


@query(_TL + "ORDER BY id DESC LIMIT 500")
def timeline(spark, sf):
    s = T.orders_state(spark, sf)
    return B.newest(s.lines, s.tomb, s.ktomb)


@query(_TL + "WHERE substr(ts, 1, 10) BETWEEN '1995-02-01' AND '1995-03-15'")
def timeline_range(spark, sf):
    return B.timeline_stored(T.orders_index(spark, sf), limit=None, first="1995-02-01", last="1995-03-15")


@query(_TL + "WHERE id < 900 AND substr(ts, 1, 10) >= '1996-01-01' ORDER BY id DESC LIMIT 40")
def timeline_page(spark, sf):
    return B.timeline_stored(T.orders_index(spark, sf), before=900, limit=40, first="1996-01-01")


@query(W + "SELECT substr(ts, 1, 10) AS day, count(*) AS n FROM firsts GROUP BY day")
def day_groups(spark, sf):
    return B.day_groups(T.orders_shown(spark, sf))


@query(W + "SELECT (SELECT count(DISTINCT id) FROM live) AS records, (SELECT count(DISTINCT k) FROM (SELECT unnest(keys) AS k FROM base)) AS keys, (SELECT count(DISTINCT id) FROM tomb) AS deleted")
def stats(spark, sf):
    """What the stored index has counted."""
    return X.stats(T.orders_index(spark, sf))


@query(W + "SELECT count(DISTINCT id) AS n FROM live")
def count_live(spark, sf):
    s = T.orders_state(spark, sf)
    return B.count_live(s.lines, s.tomb)


@query(W + ", u AS (SELECT f.* FROM firsts f WHERE list_contains(keys, '1996-05')) SELECT id, value AS snippet, extra, (SELECT count(*) FROM u) AS total FROM u ORDER BY id LIMIT 10")
def delete_preview(spark, sf):
    return B.delete_preview(T.orders_shown(spark, sf), "1996-05")


@query(W + "SELECT id, count(*) AS links FROM lines GROUP BY id HAVING count(*) > 1")
def multi_link_ids(spark, sf):
    return views.multi_link(T.orders_lines(spark, sf))


@query(W + ", n AS (SELECT key, count(*) AS n FROM postings GROUP BY key) SELECT count(*) AS keys, max(n) AS hottest, min(n) AS rarest, quantile_cont(n, 0.5)::DOUBLE AS median, count(*) FILTER (n > 1000) AS over_hot FROM n")
def posting_profile(spark, sf):
    return B.posting_profile(T.orders_postings(spark, sf), 1000)


@query("SELECT max(id) + 1 AS next_id FROM (SELECT max(o_orderkey) + 1 AS id FROM orders)")
def next_id(spark, sf):
    s = T.orders_state(spark, sf)
    return B.next_id(s.lines, s.tomb)


_LOG = "WITH log AS (SELECT o_custkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts, o_orderpriority AS key, o_orderkey AS ord FROM orders) "


def _log(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", T.ISO).alias("ts"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("ord"))


@query(_LOG + "SELECT id, arg_max(ts, ord) AS ts FROM log GROUP BY id")
def latest_tomb(spark, sf):
    return views.latest(_log(spark, sf), ["id"])


@query(_LOG + "SELECT id, key, arg_max(ts, ord) AS ts FROM log GROUP BY id, key")
def latest_key_fact(spark, sf):
    return views.latest(_log(spark, sf), ["id", "key"])


@query(_LOG + "SELECT id, arg_min(ts, ord) AS ts FROM log GROUP BY id")
def deleted_runs(spark, sf):
    return B.deleted_runs(_log(spark, sf))


@query("SELECT p_name, min(p_partkey) AS first_at FROM part GROUP BY p_name")
def ordered_distinct(spark, sf):
    return B.ordered_distinct(table(spark, sf, "part"), "p_name", "p_partkey")


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def bytes_per_source(spark, sf):
    return B.bytes_by(table(spark, sf, "documents"), "source", "text")


@query(W + "SELECT id, ord, CASE WHEN len(keys) > 0 THEN array_to_string(keys, ' ') || ' ' ELSE '' END || '-v ' || value AS line FROM shown")
def dump_kv(spark, sf):
    return dump(T.orders_state(spark, sf))


_ROWS = "WITH r AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN regexp_matches(text, '[\\r\\n]') THEN 'newline' WHEN strlen(text) + strlen(lang) >= 65536 THEN 'line_too_long' WHEN strlen(text) + 41 >= 65536 THEN 'wire_too_long' END AS reason FROM documents) "


@query(_ROWS + "SELECT coalesce(reason, 'fine') AS reason, count(*) AS n FROM r GROUP BY 1")
def write_validation(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.array("lang").alias("keys"), F.col("text").alias("value"))
    good, bad = Q.validated(rows)
    return good.withColumn("reason", F.lit("fine")).unionByName(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name AS value, count(DISTINCT p_partkey) AS records FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
def identity_audit(spark, sf):
    return Q.identity_audit(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value")))


@query(W + ", bad AS (SELECT key, id FROM postings WHERE id % 29 <> 0 UNION ALL SELECT 'stray', id FROM firsts WHERE id % 31 = 0), told AS (SELECT key, id FROM postings) SELECT key, id, 'posting' AS side FROM (SELECT * FROM bad EXCEPT SELECT * FROM told) UNION ALL SELECT key, id, 'record' FROM (SELECT * FROM told EXCEPT SELECT * FROM bad)")
def coherence_audit(spark, sf):
    shown, p = T.orders_shown(spark, sf), T.orders_postings(spark, sf)
    stray = views.first_link(shown).where("id % 31 = 0").select(F.lit("stray").alias("key"), "id")
    return Q.coherence_audit(p.where("id % 29 <> 0").unionByName(stray), shown)


def _bodies(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.where("doc_id % 3 <> 0").select((F.col("doc_id") + 1).alias("id"), F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("aisc:@")).otherwise(""), F.lit("blobs/"), "doc_id", F.lit(".txt")).alias("value"))
    return d.where("doc_id % 7 <> 0").select(F.concat(F.lit("blobs/"), "doc_id", F.lit(".txt")).alias("path")), lines


@query("SELECT 'blobs/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 3 = 0 THEN 'body' ELSE 'record' END AS side FROM documents WHERE (doc_id % 3 = 0) <> (doc_id % 7 = 0)")
def orphan_docs(spark, sf):
    return Q.orphan_documents(*_bodies(spark, sf))


@query(W + ", p AS (SELECT key, id FROM postings UNION ALL SELECT key, id FROM postings WHERE id % 40 = 0 UNION ALL SELECT key, id + 100000000 FROM postings WHERE id % 50 = 0) SELECT key, id, count(*) AS n FROM p GROUP BY key, id HAVING count(*) > 1 OR id > 100000000")
def stale_postings(spark, sf):
    p = T.orders_postings(spark, sf)
    bad = p.unionByName(p.where("id % 40 = 0")).unionByName(p.where("id % 50 = 0").select("key", (F.col("id") + 100000000).alias("id")))
    return Q.stale_postings(bad, T.orders_lines(spark, sf))


@query("""SELECT CASE WHEN regexp_matches(text, '\\n[\\s\\S]*[^\\n\\r \\t]') OR strlen(text) > 65536 THEN 'document' WHEN regexp_replace(text, '[\\n\\r \\t]+$', '') = '' THEN 'empty' ELSE 'inline' END AS form, doc_id AS seq,
  CASE WHEN regexp_matches(text, '\\n[\\s\\S]*[^\\n\\r \\t]') OR strlen(text) > 65536 THEN 'blobs/2024-01-01~' || substr(md5(text), 1, 8) || '.txt' ELSE regexp_replace(text, '[\\n\\r \\t]+$', '') END AS value FROM documents""")
def doc_split(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("value"), F.lit("2024-01-01").alias("ts"))
    return split_documents(rows).select("form", "seq", "value")
