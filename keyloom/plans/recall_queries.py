"""Recall queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import content_hash, key_encode
from ..operators import index as X
from ..operators import recall as R
from ..operators import views
from ..scratch import fresh
from ..session import table
from . import tables as T
from .registry import query

W = T.WITH_ORDERS
FNV = T.FNV


@query(W + "SELECT f.id, f.value FROM firsts f WHERE list_contains(keys, 'f') AND list_contains(keys, '1-urgent') AND list_contains(keys, '1997')")
def recall_and(spark, sf):
    index = T.orders_index(spark, sf)
    return R.resolve(X.lookup(index, ["F", "1-URGENT", "1997"]), index.records).select("id", "value")


@query(W + "SELECT DISTINCT id FROM postings WHERE key IN ('1995-03', '1996-07')")
def recall_or(spark, sf):
    return X.lookup(T.orders_index(spark, sf), ["1995-03", "1996-07", "no such key"], "any")


@query(W + "SELECT f.id FROM firsts f WHERE list_contains(keys, 'f') AND list_contains(keys, '1997')")
def recall_scan(spark, sf):
    """From the records themselves, where no index is stored."""
    return R.recall_state(T.orders_state(spark, sf), ["F", "1997"])


@query(W + "SELECT f.id FROM firsts f WHERE list_contains(keys, 'f') AND NOT list_contains(keys, '1-urgent') AND NOT list_contains(keys, '1997')")
def recall_without(spark, sf):
    """Under one key and none of others, by bits."""
    return X.lookup(T.orders_index(spark, sf), ["F"], without=["1-URGENT", "1997", "no such key"])


_EDITED = W + """, now AS (SELECT f.id, list_filter(f.keys, lambda k: NOT (f.id % 29 = 0 AND k = b.keys[2])) AS keys, f.value FROM firsts f JOIN base b USING (id) WHERE f.id % 23 <> 0
  UNION ALL SELECT id + 100000000, ['new', keys[1]], 'new/' || id FROM base WHERE id % 31 = 0) """


def _edited(spark, sf):
    """The stored index after deletes, a key taken off and new records: their rows alone are told."""
    s = T.orders_state(spark, sf)
    base = s.lines.where("ord = 0")
    dead = base.where("id % 23 = 0").select("id", F.lit(T.DELETED).alias("ts"), F.lit("").alias("hash"), F.col("id").alias("ord"))
    off = base.where("id % 29 = 0").select("id", F.lit(T.DELETED).alias("ts"), F.lit("").alias("hash"), F.col("keys")[1].alias("key"), F.col("id").alias("ord"))
    new = base.where("id % 31 = 0").select((F.col("id") + 100_000_000).alias("id"), F.lit("").alias("ts"), F.array(F.lit("new"), F.col("keys")[0]).alias("keys"), F.concat(F.lit("new/"), "id").alias("value"), "ord")
    edited = "id % 23 = 0 OR id % 29 = 0"
    part = s._replace(lines=s.lines.where(edited).unionByName(new), tomb=s.tomb.where(edited).unionByName(dead), ktomb=s.ktomb.where(edited).unionByName(off))
    return X.changed(T.orders_index(spark, sf), part, part.lines.select("id"))


@query(_EDITED + "SELECT k AS key, count(*) AS n FROM (SELECT DISTINCT unnest(keys) AS k, id FROM now) GROUP BY k")
def index_after_edits(spark, sf):
    return _edited(spark, sf).counts


@query(_EDITED + "SELECT id, value FROM now WHERE list_contains(keys, 'f') AND NOT list_contains(keys, '1-urgent')")
def recall_after_edits(spark, sf):
    index = _edited(spark, sf)
    return R.resolve(X.lookup(index, ["F"], without=["1-URGENT"]), index.records).select("id", "value")


@query(W + "SELECT id FROM postings WHERE key IN ('o', '5-low') GROUP BY id HAVING count(*) = 2")
def recall_postings(spark, sf):
    """From the stored index, as recall_or_postings, tags_stored and the batch recalls."""
    return X.lookup(T.orders_index(spark, sf), ["O", "5-LOW"])


@query(W + "SELECT DISTINCT id FROM postings WHERE key IN ('1995-03', '1996-07') AND id > 500")
def recall_or_postings(spark, sf):
    return X.lookup(T.orders_index(spark, sf), ["1995-03", "1996-07", "no such key"], "any", after=500)


@query(W + "SELECT key, id FROM postings")
def stored_postings(spark, sf):
    """What the postings sink wrote, read again."""
    return X.write_index(T.orders_state(spark, sf), fresh(spark, "index")).postings


@query(W + "SELECT id FROM postings WHERE key IN ('o', '3-medium') GROUP BY id HAVING count(*) = 2")
def recall_built_postings(spark, sf):
    """Without a stored index: postings from the records."""
    return R.recall_postings(T.orders_postings(spark, sf), ["O", "3-MEDIUM"])


_BATCH = W + ", asked AS (SELECT c_custkey AS qid, unnest([CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'o' END, (1992 + c_custkey % 7)::VARCHAR]) AS key FROM customer) "


def _batch(spark, sf):
    """Every customer asks for two keys."""
    status = F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"), F.array(status, (F.col("c_custkey") % 7 + 1992).cast("string")).alias("keys"))


def _per_query(queries, sets, *wanted):
    """What sets of (asked, id) come to, for each query that asks for them."""
    answers = sets.groupBy("asked").agg(*wanted)
    return queries.select("qid", X.asked_keys(F.col("keys")).alias("asked")).join(answers, "asked").drop("asked")


@query(_BATCH + "SELECT qid, count(*) AS hits, min(id) AS first_id, max(id) AS last_id FROM (SELECT qid, id FROM asked JOIN postings USING (key) GROUP BY qid, id HAVING count(*) = 2) GROUP BY qid")
def recall_batch_and(spark, sf):
    """Each distinct set of keys is answered once, from its rarest key."""
    queries = _batch(spark, sf)
    sets = X.lookup_sets(T.orders_index(spark, sf), queries)
    return _per_query(queries, sets, F.count(F.lit(1)).alias("hits"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(_BATCH + "SELECT qid, count(DISTINCT id) AS hits FROM asked JOIN postings USING (key) GROUP BY qid")
def recall_batch_or(spark, sf):
    """Records are counted by bits."""
    queries = _batch(spark, sf)
    return _per_query(queries, X.any_words(T.orders_index(spark, sf), queries), F.sum(F.bit_count("bits")).cast("long").alias("hits"))


_PICKY = W + ", asked AS (SELECT c_custkey AS qid, unnest([CASE WHEN c_custkey % 2 = 0 THEN 'f' ELSE 'o' END, '1-urgent', strftime(DATE '1992-01-01' + INTERVAL (c_custkey % 80) MONTH, '%Y-%m')]) AS key FROM customer WHERE c_custkey % 100 = 0) "


@query(_PICKY + "SELECT qid, id FROM asked JOIN postings USING (key) GROUP BY qid, id HAVING count(*) = 3")
def recall_batch_ids(spark, sf):
    """The hits themselves of the customers divisible by 100, who ask for three keys."""
    month = F.date_format(F.add_months(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 80).cast("int")), "yyyy-MM")
    keys = F.array(F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("O"), F.lit("1-URGENT"), month)
    return X.lookup_batch(T.orders_index(spark, sf), table(spark, sf, "customer").where("c_custkey % 100 = 0").select(F.col("c_custkey").alias("qid"), keys.alias("keys")))


@query(W + "SELECT id FROM postings WHERE key IN ('f', '2-high') AND id > 1000 GROUP BY id HAVING count(*) = 2 ORDER BY id LIMIT 20")
def recall_page(spark, sf):
    return X.lookup(T.orders_index(spark, sf), ["F", "2-HIGH"], after=1000, limit=20)


@query(W + "SELECT id FROM firsts WHERE false")
def recall_unknown_key(spark, sf):
    return R.recall(T.orders_shown(spark, sf), ["F", "nonexistent"])


@query(W + "SELECT s.id, s.ord, s.value FROM shown s WHERE s.id IN (SELECT id FROM postings WHERE key IN ('f', '1996') GROUP BY id HAVING count(*) = 2)")
def resolve_links(spark, sf):
    shown = T.orders_shown(spark, sf)
    return R.resolve(R.recall(shown, ["f", "1996"]), shown)


@query(W + "SELECT id, value, extra FROM firsts")
def first_link_extra(spark, sf):
    return views.first_link(T.orders_shown(spark, sf)).select("id", "value", "extra")


_TAGS = W + ", busy AS (SELECT key, count(*) AS n FROM postings GROUP BY key), tagged AS (SELECT id, string_agg(key, ' ' ORDER BY n DESC, key) AS tags FROM postings JOIN busy USING (key) GROUP BY id) "


@query(_TAGS + "SELECT id, tags FROM tagged WHERE id IN (SELECT id FROM postings WHERE key = '1998')")
def recall_with_tags(spark, sf):
    index = T.orders_index(spark, sf)
    return X.tagged(index, X.lookup(index, ["1998"])).select("id", F.array_join("tags", " ").alias("tags"))


@query(_TAGS + "SELECT id, tags FROM tagged WHERE id = 24")
def keys_of_record(spark, sf):
    return X.tagged(T.orders_index(spark, sf), spark.range(24, 25)).select("id", F.array_join("tags", " ").alias("tags"))


@query(W + "SELECT value, min(id) AS id FROM lines WHERE value IN (SELECT 'order/' || (c_custkey * 3) FROM customer) GROUP BY value")
def value_lookup(spark, sf):
    asked = table(spark, sf, "customer").select(F.concat(F.lit("order/"), (F.col("c_custkey") * 3).cast("string")).alias("value"))
    return R.find_values(T.orders_lines(spark, sf), asked)


@query(W + "SELECT hash, min(id) AS id FROM (SELECT md5(value) AS hash, id FROM lines) WHERE hash IN (SELECT md5('order/' || c_custkey) FROM customer) GROUP BY hash")
def hash_lookup(spark, sf):
    asked = table(spark, sf, "customer").select(F.md5(F.concat(F.lit("order/"), F.col("c_custkey").cast("string"))).alias("hash"))
    return R.find_hashes(T.orders_lines(spark, sf), asked, F.md5)


@query(W + f", h AS (SELECT id, {FNV} AS hash FROM lines) SELECT hash, min(id) AS id FROM h WHERE hash IN (SELECT {FNV} FROM (SELECT 'order/' || (c_custkey * 2) AS value FROM customer)) GROUP BY hash")
def content_hash_lookup(spark, sf):
    asked = table(spark, sf, "customer").select(content_hash(F.concat(F.lit("order/"), (F.col("c_custkey") * 2).cast("string"))).alias("hash"))
    return R.find_hashes(T.orders_lines(spark, sf), asked)


def _sets(spark, sf):
    p = T.orders_index(spark, sf).postings
    return tuple(p.where(F.col("key") == k).select("id") for k in ("f", "1-urgent"))


@query(W + "SELECT id FROM postings WHERE key = 'f' INTERSECT SELECT id FROM postings WHERE key = '1-urgent'")
def set_intersect(spark, sf):
    a, b = _sets(spark, sf)
    return a.intersect(b)


@query(W + "SELECT id FROM postings WHERE key = 'f' UNION SELECT id FROM postings WHERE key = '1-urgent'")
def set_union(spark, sf):
    a, b = _sets(spark, sf)
    return a.union(b).distinct()


@query(W + "SELECT id FROM postings WHERE key = 'f' EXCEPT SELECT id FROM postings WHERE key = '1-urgent'")
def set_except(spark, sf):
    return R.set_difference(*_sets(spark, sf))


@query(W + "SELECT id, id IN (SELECT id FROM postings WHERE key = 'f') AS has FROM postings WHERE key = '1-urgent'")
def set_contains(spark, sf):
    a, b = _sets(spark, sf)
    return R.set_contains(a, b)


@query(W + "SELECT id FROM postings WHERE key = 'f' UNION SELECT id FROM firsts WHERE id < 500 EXCEPT SELECT id FROM firsts WHERE id % 3 = 0")
def set_add_remove(spark, sf):
    ids = T.orders_index(spark, sf).records.select("id")
    return R.set_difference(R.set_add(_sets(spark, sf)[0], ids.where("id < 500")), ids.where("id % 3 = 0"))


@query(W + "SELECT a.pos::INT AS pos, s.id, s.ord, s.value FROM (VALUES (0, '1998-01'), (1, '1992-02')) a(pos, key) JOIN postings p ON p.key = a.key JOIN shown s ON s.id = p.id")
def per_key_cat(spark, sf):
    return R.key_cat(T.orders_postings(spark, sf), T.orders_shown(spark, sf), ["1998-01", "1992-02"])


@query(f"SELECT DISTINCT {T.ek('p_type')} AS key FROM part")
def key_encode_types(spark, sf):
    return table(spark, sf, "part").select(key_encode(F.col("p_type")).alias("key")).distinct()
