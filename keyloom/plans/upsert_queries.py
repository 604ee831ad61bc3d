"""Upsert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as U
from ..operators import views
from ..session import table
from . import tables as T
from .registry import query

W = T.WITH_ORDERS

# Part names under brand and type, put into an index that already holds names of sizes 1 to 10 of the smallest part each.
_PUT = f"""WITH known AS (SELECT p_name AS value, min(p_partkey) + 1 AS id FROM part WHERE p_size <= 3 GROUP BY p_name),
arrived AS (SELECT p_name AS value, min(p_partkey) AS seq FROM part GROUP BY p_name),
k AS (SELECT value, key, ekey, seq, pos FROM (SELECT p_name AS value, p_partkey AS seq, unnest([p_brand, p_type]) AS key, unnest([0, 1]) AS pos FROM part), LATERAL (SELECT {T.ek("key")} AS ekey)),
fk AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY value, ekey ORDER BY seq, pos) = 1),
merged AS (SELECT value, string_agg(key, '/' ORDER BY seq, pos) FILTER (true) AS keys, string_agg(key, '/' ORDER BY seq, pos) FILTER (ekey <> 'old') AS fresh FROM fk GROUP BY value),
top AS (SELECT coalesce(max(id), 0) AS m FROM known)
SELECT coalesce(n.id, top.m + row_number() OVER (PARTITION BY n.id IS NULL ORDER BY a.seq)) AS id, a.value, CASE WHEN n.id IS NULL THEN m.keys ELSE 'old/' || m.fresh END AS keys
FROM arrived a JOIN merged m USING (value) LEFT JOIN known n USING (value), top"""


@query(_PUT)
def bulk_put(spark, sf):
    p = table(spark, sf, "part")
    known = p.where("p_size <= 3").groupBy(F.col("p_name").alias("value")).agg((F.min("p_partkey") + 1).alias("id"))
    lines = known.select("id", F.lit("").alias("ts"), F.array(F.lit("old")).alias("keys"), "value", F.lit(0).cast("long").alias("ord"))
    start = lines.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return U.bulk_put(lines, T.parts_arrivals(spark, sf), start).select("id", "value", F.array_join("keys", "/").alias("keys"))


_ARRIVE = "arrive AS (SELECT 'order/' || (o_orderkey * 2) AS value, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN '2019-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS ts FROM orders)"


@query(W + f", {_ARRIVE} SELECT a.value, CASE WHEN l.id IS NULL THEN 'new' WHEN t.id IS NULL THEN 'known' WHEN coalesce(a.ts, '~') > t.ts THEN 'back' ELSE 'dead' END AS status FROM arrive a LEFT JOIN lines l ON l.value = a.value LEFT JOIN tomb t ON t.id = l.id")
def put_vs_tomb(spark, sf):
    s = T.orders_state(spark, sf)
    k = F.col("o_orderkey")
    ts = F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "2019-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z")
    arrive = table(spark, sf, "orders").select(F.concat(F.lit("order/"), (k * 2).cast("string")).alias("value"), ts.alias("ts"))
    return U.put_status(s.lines, s.tomb, arrive)


@query(W + ", asked AS (SELECT o_orderkey + 1 AS id, 'order/' || (o_orderkey + o_orderkey % 3) || CASE WHEN o_orderkey % 3 = 2 THEN '/new' ELSE '' END AS value FROM orders WHERE o_orderkey % 4 = 0) SELECT a.id, a.value, CASE WHEN l.id IS NULL THEN -1 WHEN o.id = a.id THEN 1 WHEN o.id IS NOT NULL THEN -2 ELSE 0 END AS status FROM asked a LEFT JOIN (SELECT DISTINCT id FROM live) l ON l.id = a.id LEFT JOIN lines o ON o.value = a.value")
def add_link(spark, sf):
    s = T.orders_state(spark, sf)
    k = F.col("o_orderkey")
    value = F.concat(F.lit("order/"), (k + k % 3).cast("string"), F.when(k % 3 == 2, "/new").otherwise(""))
    return U.add_link(s.lines, s.tomb, table(spark, sf, "orders").where(k % 4 == 0).select((k + 1).alias("id"), value.alias("value")))


_EDITS = """edits AS (SELECT o_orderkey + 1 AS id, o_orderkey * 10 + i AS seq, k AS key, CASE WHEN starts_with(k0, '-') THEN 'detach' ELSE 'attach' END AS op FROM (
  SELECT o_orderkey, unnest(['hot', '-F', '-hot', 'new']) AS k0, unnest([0, 0, 1, 1]) AS i, unnest(['hot', 'f', 'hot', 'new']) AS k FROM orders WHERE o_orderkey % 3 = 0)),
last AS (SELECT id, key, op FROM edits WHERE id IN (SELECT id FROM live) QUALIFY row_number() OVER (PARTITION BY id, key ORDER BY seq DESC, op DESC) = 1)"""


def _edits(spark, sf):
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").where(k % 3 == 0)
    one = o.select((k + 1).alias("id"), (k * 10).alias("seq"), F.array(F.lit("hot"), F.lit("-F")).alias("keys"))
    return one.unionByName(o.select((k + 1).alias("id"), (k * 10 + 1).alias("seq"), F.array(F.lit("-hot"), F.lit("new")).alias("keys")))


@query(W + f", {_EDITS} SELECT id, key FROM (SELECT id, key FROM ktomb EXCEPT SELECT id, key FROM last WHERE op = 'attach' UNION SELECT id, key FROM last WHERE op = 'detach')")
def update_keys(spark, sf):
    s = T.orders_state(spark, sf)
    return U.update_keys(s.lines, s.tomb, s.ktomb, _edits(spark, sf))[1]


@query(W + f", {_EDITS} SELECT l.id, array_to_string(l.keys || CASE WHEN l.ord = 0 AND e.id IS NOT NULL THEN ['new'] ELSE [] END, '/') AS keys, l.value FROM lines l LEFT JOIN (SELECT id FROM last WHERE op = 'attach' AND key = 'new') e ON e.id = l.id")
def updated_lines(spark, sf):
    s = T.orders_state(spark, sf)
    return U.update_keys(s.lines, s.tomb, s.ktomb, _edits(spark, sf))[0].select("id", F.array_join("keys", "/").alias("keys"), "value")


_SET = "edits AS (SELECT id, value AS old, CASE WHEN id % 4 = 0 THEN 'order/' || (id + 5) WHEN id % 4 = 1 THEN 'changed/' || id WHEN id % 4 = 2 THEN 'a' || chr(10) || 'b' ELSE value END AS new FROM base WHERE id % 3 = 0)"


@query(W + f", {_SET} SELECT e.id, e.old, e.new, CASE WHEN contains(e.new, chr(10)) THEN -3 WHEN l.id IS NULL THEN -1 WHEN o.id IS NOT NULL AND o.id <> e.id THEN -2 ELSE 0 END AS status FROM edits e LEFT JOIN live l ON l.id = e.id AND l.value = e.old LEFT JOIN lines o ON o.value = e.new")
def set_value(spark, sf):
    s = T.orders_state(spark, sf)
    return U.set_value(s.lines, s.tomb, _set_edits(s))


def _set_edits(s):
    new = F.when(F.col("id") % 4 == 0, F.concat(F.lit("order/"), (F.col("id") + 5).cast("string"))).when(F.col("id") % 4 == 1, F.concat(F.lit("changed/"), "id")).when(F.col("id") % 4 == 2, "a\nb").otherwise(F.col("value"))
    return s.lines.where("ord = 0 AND id % 3 = 0").select("id", F.col("value").alias("old"), new.alias("new"))


@query(W + f", {_SET}, done AS (SELECT e.* FROM edits e JOIN live l ON l.id = e.id AND l.value = e.old WHERE e.id % 4 IN (1, 3)) SELECT l.id, l.ord, coalesce(d.new, l.value) AS value FROM lines l LEFT JOIN done d ON d.id = l.id AND d.old = l.value")
def set_value_lines(spark, sf):
    s = T.orders_state(spark, sf)
    done = U.set_value(s.lines, s.tomb, _set_edits(s)).where("status = 0 AND id % 4 IN (1, 3)")
    return U.apply_set_value(s.lines, done).select("id", "ord", "value")


@query(W + "SELECT id, ts FROM tomb UNION ALL SELECT id, '2024-05-05T00:00:00Z' FROM base WHERE id % 9 = 0 AND id % 17 <> 0")
def delete_ids(spark, sf):
    s = T.orders_state(spark, sf)
    ids = s.lines.where("id % 9 = 0").select("id")
    return U.delete_ids(s.lines, s.tomb, ids, "2024-05-05T00:00:00Z").select("id", "ts")


@query(W + "SELECT id, '2024-05-05T00:00:00Z' AS ts, id NOT IN (SELECT id FROM tomb) AS counted FROM base WHERE list_contains(keys, '4-not_specified')")
def delete_under(spark, sf):
    s = T.orders_state(spark, sf)
    return U.delete_under(s.lines, s.tomb, "4-NOT SPECIFIED", "2024-05-05T00:00:00Z")


@query(W + "SELECT id, key FROM ktomb UNION SELECT id, '3-medium' FROM base WHERE list_contains(keys, '3-medium')")
def untag(spark, sf):
    s = T.orders_state(spark, sf)
    return U.untag(s.lines, s.ktomb, "3-MEDIUM")


def _facts(s):
    """(kind, id, key, ts, hash) of a state's tombstones, key facts and edit clock."""
    none = F.lit(None).cast("string")
    parts = [("tomb", s.tomb.withColumn("key", none)), ("ktomb", s.ktomb), ("katt", s.katt), ("mts", s.mts.withColumns({"key": none, "hash": none}))]
    rows = [df.select(F.lit(kind).alias("kind"), "id", "key", "ts", "hash") for kind, df in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


_AS_OF = "'2024-05-05T00:00:00Z'"
_HASHED = f", hashed AS (SELECT id, {T.FNV} AS hash FROM base)"
_KINDS = "SELECT 'tomb' AS kind, id, NULL AS key, ts, hash FROM tomb2 UNION ALL SELECT 'ktomb', id, key, ts, hash FROM ktomb2 UNION ALL SELECT 'katt', id, key, ts, hash FROM katt2 UNION ALL SELECT 'mts', id, NULL, ts, NULL FROM mts2"


@query(W + f""", {_EDITS} {_HASHED}, att AS (SELECT id, key FROM last WHERE op = 'attach'), det AS (SELECT id, key FROM last WHERE op = 'detach'), ever AS (SELECT DISTINCT id, key FROM edits WHERE op = 'attach' AND id IN (SELECT id FROM live)),
tomb2 AS (SELECT * FROM tomb), k1 AS (SELECT * FROM ktomb k WHERE NOT EXISTS (SELECT 1 FROM ever e WHERE e.id = k.id AND e.key = k.key)),
ktomb2 AS (SELECT id, ts, hash, key FROM k1 UNION ALL SELECT d.id, {_AS_OF}, h.hash, d.key FROM det d JOIN hashed h USING (id) WHERE NOT EXISTS (SELECT 1 FROM k1 WHERE k1.id = d.id AND k1.key = d.key)),
katt2 AS (SELECT id, ts, hash, key FROM katt t WHERE NOT EXISTS (SELECT 1 FROM last l WHERE l.id = t.id AND l.key = t.key) UNION ALL SELECT a.id, {_AS_OF}, h.hash, a.key FROM att a JOIN hashed h USING (id)),
ed AS (SELECT DISTINCT id FROM edits WHERE id IN (SELECT id FROM live)), mts2 AS (SELECT id, ts FROM mts WHERE id NOT IN (SELECT id FROM ed) UNION ALL SELECT id, {_AS_OF} FROM ed) {_KINDS}""")
def update_keys_facts(spark, sf):
    return _facts(U.edit_state(T.orders_state(spark, sf), _edits(spark, sf), "2024-05-05T00:00:00Z"))


@query(W + f"""{_HASHED}, under AS (SELECT id FROM base WHERE list_contains(keys, '4-not_specified')), tomb2 AS (SELECT id, ts, hash FROM tomb WHERE id NOT IN (SELECT id FROM under) UNION ALL SELECT id, {_AS_OF}, hash FROM hashed WHERE id IN (SELECT id FROM under)),
ktomb2 AS (SELECT * FROM ktomb), katt2 AS (SELECT * FROM katt WHERE id NOT IN (SELECT id FROM under)), mts2 AS (SELECT * FROM mts WHERE id NOT IN (SELECT id FROM under)) {_KINDS}""")
def delete_under_facts(spark, sf):
    return _facts(U.delete_under_state(T.orders_state(spark, sf), "4-NOT SPECIFIED", "2024-05-05T00:00:00Z"))


@query(W + f"""{_HASHED}, under AS (SELECT id FROM base WHERE list_contains(keys, '3-medium')), tomb2 AS (SELECT * FROM tomb),
ktomb2 AS (SELECT id, ts, hash, key FROM ktomb UNION ALL SELECT id, {_AS_OF}, hash, '3-medium' FROM hashed WHERE id IN (SELECT id FROM under) AND id NOT IN (SELECT id FROM ktomb WHERE key = '3-medium')),
katt2 AS (SELECT * FROM katt WHERE NOT (key = '3-medium' AND id IN (SELECT id FROM under))), ed AS (SELECT id FROM under WHERE id NOT IN (SELECT id FROM tomb)),
mts2 AS (SELECT id, ts FROM mts WHERE id NOT IN (SELECT id FROM ed) UNION ALL SELECT id, {_AS_OF} FROM ed) {_KINDS}""")
def untag_facts(spark, sf):
    return _facts(U.untag_state(T.orders_state(spark, sf), "3-MEDIUM", "2024-05-05T00:00:00Z"))


@query(W + f"""{_HASHED}, gone AS (SELECT id FROM base WHERE id % 9 = 0 AND id NOT IN (SELECT id FROM tomb)), tomb2 AS (SELECT id, ts, hash FROM tomb UNION ALL SELECT id, {_AS_OF}, hash FROM hashed WHERE id IN (SELECT id FROM gone)),
ktomb2 AS (SELECT * FROM ktomb), katt2 AS (SELECT * FROM katt WHERE id NOT IN (SELECT id FROM gone)), mts2 AS (SELECT * FROM mts WHERE id NOT IN (SELECT id FROM gone)) {_KINDS} UNION ALL SELECT 'sts', id, NULL, ts, NULL FROM sts WHERE id NOT IN (SELECT id FROM gone)""")
def delete_ids_facts(spark, sf):
    s = T.orders_state(spark, sf)
    out = U.delete_ids_state(s, s.lines.where("id % 9 = 0").select("id"), "2024-05-05T00:00:00Z")
    none = F.lit(None).cast("string")
    return _facts(out).unionByName(out.sts.select(F.lit("sts").alias("kind"), "id", none.alias("key"), "ts", none.alias("hash")))


@query(W + f""", {_SET}, done AS (SELECT DISTINCT e.id FROM edits e JOIN live l ON l.id = e.id AND l.value = e.old LEFT JOIN lines o ON o.value = e.new WHERE NOT contains(e.new, chr(10)) AND (o.id IS NULL OR o.id = e.id)),
tomb2 AS (SELECT * FROM tomb), ktomb2 AS (SELECT * FROM ktomb), katt2 AS (SELECT * FROM katt), mts2 AS (SELECT id, ts FROM mts WHERE id NOT IN (SELECT id FROM done) UNION ALL SELECT id, {_AS_OF} FROM done) {_KINDS}""")
def set_value_facts(spark, sf):
    s = T.orders_state(spark, sf)
    return _facts(U.set_value_state(s, _set_edits(s), "2024-05-05T00:00:00Z"))


@query(W + "SELECT id, ts, array_to_string(keys, ' ') AS keys, value, ord FROM shown")
def compact_lines(spark, sf):
    s = T.orders_state(spark, sf)
    return U.compact(s.lines, s.tomb, s.ktomb).select("id", "ts", F.array_join("keys", " ").alias("keys"), "value", "ord")


@query(W + "SELECT 'tomb' AS kind, id, hash FROM tomb WHERE hash <> '' UNION ALL SELECT 'ktomb', id, hash FROM ktomb WHERE hash <> '' UNION ALL SELECT 'katt', id, hash FROM katt a WHERE id NOT IN (SELECT id FROM tomb) AND NOT EXISTS (SELECT 1 FROM ktomb k WHERE k.id = a.id AND k.key = a.key)")
def compact_facts(spark, sf):
    s = T.orders_state(spark, sf)
    parts = [df.select(F.lit(k).alias("kind"), "id", "hash") for k, df in zip(("tomb", "ktomb", "katt"), U.compact_facts(s.tomb, s.ktomb, s.katt), strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(W + "SELECT id, ts, '' AS hash FROM tomb")
def purge(spark, sf):
    return U.purge(T.orders_state(spark, sf).tomb).select("id", "ts", "hash")


def _doc_lines(spark, sf):
    d = table(spark, sf, "documents")
    lines = d.select((F.col("doc_id") + 1).alias("id"), F.lit("").alias("ts"), F.array("lang").alias("keys"), F.concat(F.when(F.col("doc_id") % 4 == 0, F.lit("x/")).otherwise(F.lit("")), F.lit("blobs/"), (F.col("doc_id") % 300).cast("string")).alias("value"), F.col("doc_id").alias("ord"))
    return lines, lines.where("id % 2 = 0").select("id")


@query("WITH l AS (SELECT doc_id + 1 AS id, CASE WHEN doc_id % 4 = 0 THEN 'x/' ELSE '' END || 'blobs/' || (doc_id % 300) AS value FROM documents) SELECT DISTINCT value FROM l WHERE id % 2 = 0 AND starts_with(value, 'blobs/') AND value NOT IN (SELECT value FROM l WHERE id % 2 <> 0)")
def discard_list(spark, sf):
    lines, dead = _doc_lines(spark, sf)
    return U.discard_list(lines, dead)


@query("SELECT doc_id, regexp_matches(text, 'thion|[0-9]{4}') AS removed FROM documents")
def delete_pattern(spark, sf):
    return U.delete_pattern(table(spark, sf, "documents").select("doc_id", "text"), "text", "thion|[0-9]{4}").drop("text")


@query(W + "SELECT b.id, b.ts, greatest(b.ts, coalesce(m.ts, ''), coalesce(s.ts, '')) AS edit_ts, greatest(b.ts, coalesce(s.ts, '')) AS survival_ts FROM base b LEFT JOIN mts m USING (id) LEFT JOIN sts s USING (id)")
def effective_clocks(spark, sf):
    s = T.orders_state(spark, sf)
    return views.effective_clocks(s.lines, s.mts, s.sts)


@query(f"""WITH n AS (SELECT p_name AS value, min(p_partkey) AS seq, min({T.ek("p_brand")}) AS brand FROM part WHERE p_size > 40 GROUP BY p_name) SELECT value, row_number() OVER (ORDER BY seq) AS id FROM n""")
def pick_some(spark, sf):
    """Taking only the records that a predicate chooses from another index."""
    p = T.parts_arrivals(spark, sf).join(table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("seq")), "seq", "left_semi")
    none = T.orders_lines(spark, sf).where("false")
    return U.bulk_put(none, p, 0).select("value", "id")
