"""Queries over column functions and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..scratch import fresh
from ..session import table
from ..sources import readers as S
from ..sources.sinks import write_store
from . import tables as T
from .registry import query

ek = T.ek
_K = "'-' || p_brand || ' / ' || p_type"


@query(f"SELECT p_partkey, {ek('p_name')} AS name, {ek(_K)} AS mixed, {ek(chr(39) + '.' + chr(39) + ' || p_type')} AS dotted FROM part")
def key_encode(spark, sf):
    p = table(spark, sf, "part")
    mixed = F.concat(F.lit("-"), "p_brand", F.lit(" / "), "p_type")
    return p.select("p_partkey", X.key_encode(F.col("p_name")).alias("name"), X.key_encode(mixed).alias("mixed"), X.key_encode(F.concat(F.lit("."), "p_type")).alias("dotted"))


@query(f"WITH k AS (SELECT doc_id, {ek('regexp_extract(text, chr(91) || chr(94) || chr(32) || chr(93) || chr(43))')} AS key FROM documents) SELECT doc_id, key, CASE WHEN key = '' THEN '' WHEN ascii(key) < 128 THEN substr(key, 1, 2) ELSE substr(key, 1, 1) END AS prefix FROM k")
def key_prefix(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", X.key_encode(F.regexp_extract("text", "[^ ]+", 0)).alias("key"))
    return d.select("doc_id", "key", X.key_prefix(F.col("key")).alias("prefix"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f|]', '_', 'g') AS stored FROM documents")
def key_fold_stored(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.key_fold_stored(F.col("text")).alias("stored"))


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f|]', '_', 'g') AS stored, coalesce(try_cast(text AS DOUBLE), 0) AS num FROM documents")
def key_fold_whole(spark, sf):
    """Texts as stored keys and as numbers."""
    return table(spark, sf, "documents").select("doc_id", X.key_fold_stored(F.col("text")).alias("stored"), X.safe_num(F.col("text")).alias("num"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_name || '  ' || p_type, '[ \t]+'), lambda x: x <> ''), '/') AS keys, trim(regexp_replace(replace(p_name || ', ' || p_type || ',', ',', ' '), '\\s+', ' ', 'g')) AS typed FROM part")
def tokenise(spark, sf):
    p = table(spark, sf, "part")
    typed = F.concat("p_name", F.lit(", "), "p_type", F.lit(","))
    return p.select("p_partkey", F.array_join(X.tokenise_keys(F.concat("p_name", F.lit("  "), "p_type")), "/").alias("keys"), X.normalise_typed(typed).alias("typed"))


_AB = "WITH k AS (SELECT p_partkey, [p_brand, p_type] AS a, [upper(p_type), 'size ' || p_size, p_brand] AS b FROM part) "


def _ab(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.array("p_brand", "p_type").alias("a"), F.array(F.upper("p_type"), F.concat(F.lit("size "), "p_size"), F.col("p_brand")).alias("b"))


@query(_AB + f", u AS (SELECT p_partkey, unnest(a || b) AS k, generate_subscripts(a || b, 1) AS i FROM k), f AS (SELECT p_partkey, k, i FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey, {ek('k')} ORDER BY i) = 1) SELECT p_partkey, string_agg(k, '/' ORDER BY i) AS keys FROM f GROUP BY p_partkey")
def key_union(spark, sf):
    return _ab(spark, sf).select("p_partkey", F.array_join(X.keys_union(F.col("a"), F.col("b")), "/").alias("keys"))


@query(_AB + f"SELECT p_partkey, list_contains(list_transform(a, lambda x: {ek('x')}), {ek('b[1]')}) AS has FROM k")
def keys_contain(spark, sf):
    return _ab(spark, sf).select("p_partkey", X.keys_contain(F.col("a"), F.col("b")[0]).alias("has"))


@query(_AB + "SELECT p_partkey, array_to_string(list_transform(list_filter(a, lambda x: NOT list_contains(b, x)), lambda x: '-' || x) || list_filter(b, lambda x: NOT list_contains(a, x)), '/') AS edits FROM k")
def key_diff(spark, sf):
    return _ab(spark, sf).select("p_partkey", F.array_join(X.key_diff(F.col("b"), F.col("a")), "/").alias("edits"))


@query("WITH k AS (SELECT p_partkey, ['-' || p_brand, p_type, '-', '-' || p_size] AS e FROM part) SELECT p_partkey, array_to_string(list_filter(e, lambda x: NOT (x LIKE '-%' AND length(x) > 1)), '/') AS on_, array_to_string(list_transform(list_filter(e, lambda x: x LIKE '-%' AND length(x) > 1), lambda x: substr(x, 2)), '/') AS off_ FROM k")
def edit_split(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.array(F.concat(F.lit("-"), "p_brand"), F.col("p_type"), F.lit("-"), F.concat(F.lit("-"), "p_size")).alias("e"))
    return p.select("p_partkey", F.array_join(X.attaches(F.col("e")), "/").alias("on_"), F.array_join(X.detaches(F.col("e")), "/").alias("off_"))


_TS = """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
  WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT23:59:59Z') WHEN 4 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || 'x' END AS ts FROM orders) """


def _stamps(spark, sf):
    at = F.col("o_orderdate")
    shapes = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T23:59:59Z'", "yyyy", "yyyy-MM-dd'T'HH:mm:ss'Zx'"]
    ts = F.element_at(F.array(*[F.date_format(at, s) for s in shapes]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", ts.alias("ts"))


@query(_TS + "SELECT o_orderkey, ts, regexp_matches(ts, '^\\d{4}-\\d{2}-\\d{2}(T\\d{2}:\\d{2}(:\\d{2}Z?)?)?$') AS ok FROM t")
def ts_shape(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", "ts", X.looks_like_ts(F.col("ts")).alias("ok"))


@query(_TS + "SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN strftime(strptime(ts, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%SZ') END AS next_ts FROM t")
def ts_next_second(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", X.ts_next_second(F.col("ts")).alias("next_ts"))


@query(_TS + "SELECT o_orderkey, substr(ts, 1, 10) >= '1996-02-01' AND substr(ts, 1, 10) <= '1997-03-04' AS inside FROM t")
def date_range(spark, sf):
    return _stamps(spark, sf).select("o_orderkey", X.in_date_range(F.col("ts"), "1996-02-01T10:00", "1997-03-04").alias("inside"))


_VALUES = """WITH v AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN 'aisc:@blobs/' || page_id WHEN 2 THEN 'aisc:' || url WHEN 3 THEN 'blobs/' || page_id || '.txt' WHEN 4 THEN '/' || url WHEN 5 THEN 'mailto:' || page_id ELSE 'page ' || page_id || CASE WHEN page_id % 2 = 0 THEN '/x' ELSE '' END END AS value FROM pages) """


def _values(spark, sf):
    u, n = F.col("url"), F.col("page_id").cast("string")
    kinds = [u, F.concat(F.lit("aisc:@blobs/"), n), F.concat(F.lit("aisc:"), u), F.concat(F.lit("blobs/"), n, F.lit(".txt")), F.concat(F.lit("/"), u), F.concat(F.lit("mailto:"), n), F.concat(F.lit("page "), n, F.when(F.col("page_id") % 2 == 0, "/x").otherwise(""))]
    return table(spark, sf, "pages").select("page_id", F.element_at(F.array(*kinds), (F.col("page_id") % 7 + 1).cast("int")).alias("value"))


@query(_VALUES + """SELECT page_id, value, CASE WHEN starts_with(value, 'aisc:@') THEN 'secret_blob' WHEN starts_with(value, 'aisc:') THEN 'secret_inline' WHEN starts_with(value, 'blobs/') THEN 'blob_ref'
  WHEN regexp_matches(value, '^https?://') THEN 'url' WHEN regexp_matches(value, '^[A-Za-z][A-Za-z0-9+.-]*:[^ ]') THEN 'uri' WHEN starts_with(value, '/') THEN 'abs_path' WHEN regexp_matches(value, '^[^ ]+/[^ ]*$') THEN 'rel_path' ELSE 'text' END AS kind FROM v""")
def value_kind(spark, sf):
    return _values(spark, sf).select("page_id", "value", X.value_kind(F.col("value")).alias("kind"))


@query(_VALUES + "SELECT page_id, regexp_matches(value, '^blobs/[^/\\\\]+$') AND NOT contains(value, '..') AS safe, starts_with(value, 'aisc:') AS secret FROM v")
def safe_paths(spark, sf):
    return _values(spark, sf).select("page_id", X.safe_path(F.col("value")).alias("safe"), F.col("value").startswith(X.SECRET).alias("secret"))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END, 'blobs/' || doc_id) AS shown, CASE WHEN length(text) > 68 THEN substr(text, 1, 68) || '...' ELSE text END AS snippet FROM documents")
def doc_preview(spark, sf):
    d = table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 4 != 0, F.col("text"))
    return d.select("doc_id", X.preview(body, F.concat(F.lit("blobs/"), "doc_id"), 100).alias("shown"), X.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS log_tokens, strlen(text) // 4 AS byte_tokens, coalesce(try_cast(text AS DOUBLE), 0) AS num FROM documents")
def approx_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.approx_tokens_log(F.col("text")).alias("log_tokens"), X.approx_tokens_bytes(F.col("text")).alias("byte_tokens"), X.safe_num(F.col("text")).alias("num"))


@query("SELECT o_orderkey, 'shop/' || strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%Y-%m-%d') || '/photo' AS keys FROM orders")
def date_facets(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.array_join(X.with_project(X.date_facets(F.col("o_orderdate"), ["photo"]), "shop"), "/").alias("keys"))


_FACT_LINES = """WITH l AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'A|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|k1 k2|user|' || user_id WHEN 1 THEN 'D|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|' || user_id
  WHEN 2 THEN 'K|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|' || user_id || '|k' WHEN 3 THEN 'M|' || user_id || '|a|b' WHEN 4 THEN '# note' WHEN 5 THEN 'Z9|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|x'
  WHEN 6 THEN 'A||k|now' WHEN 7 THEN 'D|short' ELSE ' ' END AS line FROM events) """


def _fact_lines(spark, sf):
    e = table(spark, sf, "events")
    ts, user = F.date_format("ts", T.ISO), F.col("user_id").cast("string")
    c = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    lines = [c("A|", ts, "|k1 k2|user|", user), c("D|", ts, "|", user), c("K|", ts, "|", user, "|k"), c("M|", user, "|a|b"), F.lit("# note"), c("Z9|", ts, "|x"), F.lit("A||k|now"), F.lit("D|short"), F.lit(" ")]
    return e.select("event_id", F.element_at(F.array(*lines), (F.col("event_id") % 9 + 1).cast("int")).alias("line"))


@query(_FACT_LINES + """SELECT event_id, CASE event_id % 9 WHEN 4 THEN 'skip' WHEN 8 THEN 'skip' WHEN 5 THEN 'unknown' WHEN 7 THEN 'plain' ELSE 'fact' END AS status, CASE WHEN event_id % 9 IN (0, 1, 2, 3, 6) THEN line[1] END AS verb,
  CASE WHEN event_id % 9 IN (0, 1, 2) THEN string_split(line, '|')[2] WHEN event_id % 9 = 6 THEN '2024-01-01T00:00:00Z' END AS ts,
  CASE event_id % 9 WHEN 1 THEN string_split(line, '|')[3] WHEN 2 THEN string_split(line, '|')[3] WHEN 3 THEN string_split(line, '|')[2] END AS hash,
  CASE event_id % 9 WHEN 0 THEN regexp_extract(line, '^([^|]*\\|){3}(.*)$', 2) WHEN 3 THEN 'a|b' WHEN 6 THEN 'now' END AS value, CASE event_id % 9 WHEN 0 THEN 'k1/k2' WHEN 6 THEN 'k' END AS keys FROM l""")
def parse_facts(spark, sf):
    out = S.parse_facts(_fact_lines(spark, sf), "2024-01-01T00:00:00Z")
    return out.select("event_id", "status", "verb", "ts", "hash", "value", F.array_join("keys", "/").alias("keys"))


@query(_FACT_LINES + "SELECT event_id, line FROM l WHERE regexp_matches(line, '^[A-Z][A-Z0-9]{0,2}\\|\\d{4}-\\d{2}-\\d{2}T') AND regexp_extract(line, '^([A-Z0-9]+)\\|', 1) NOT IN ('A', 'C', 'D', 'K', 'T', 'M', 'B')")
def verb_quarantine(spark, sf):
    return _fact_lines(spark, sf).where(S.is_quarantined(F.col("line")))


_KV = "WITH l AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || ' tools -v ' || p_name || ' -v x | y' WHEN 1 THEN '-v ' || p_name WHEN 2 THEN p_type || ' --value  ' || p_size ELSE p_name || '-v none' END AS line FROM part) "


@query(_KV + """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN array_to_string(string_split(regexp_extract(line, '^(.*?) -v ', 1), ' '), '/') WHEN 1 THEN '' WHEN 2 THEN replace(regexp_extract(line, '^(.*?) --value ', 1), ' ', '/') END AS keys,
  CASE p_partkey % 4 WHEN 0 THEN regexp_extract(line, '^.*? -v (.*)$', 1) WHEN 1 THEN substr(line, 4) WHEN 2 THEN regexp_extract(line, ' --value (.*)$', 1) END AS value FROM l""")
def parse_kv(spark, sf):
    p, c = table(spark, sf, "part"), lambda *x: F.concat(*[F.lit(i) if i[0] == "'" or i.startswith(" ") or i.startswith("-") else F.col(i) for i in x])
    lines = [c("p_brand", " tools -v ", "p_name", " -v x | y"), c("-v ", "p_name"), F.concat("p_type", F.lit(" --value  "), F.col("p_size").cast("string")), c("p_name", "-v none")]
    kv = S.parse_kv(F.col("line"))
    rows = p.select("p_partkey", F.element_at(F.array(*lines), (F.col("p_partkey") % 4 + 1).cast("int")).alias("line")).withColumn("kv", kv)
    return rows.select("p_partkey", F.array_join("kv.keys", "/").alias("keys"), "kv.value")


_OLD = "WITH l AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '|' || p_brand || '|' || p_name || '|z' WHEN 1 THEN p_type || '|' || p_name ELSE p_name END AS line FROM part) "


@query(_OLD + "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey || '/' || array_to_string(list_filter(string_split(string_split(line, '|')[2], ' '), lambda x: x <> ''), '/') WHEN 1 THEN array_to_string(list_filter(string_split(string_split(line, '|')[1], ' '), lambda x: x <> ''), '/') END AS keys, CASE p_partkey % 3 WHEN 0 THEN string_split(line, '|')[3] || '|z' WHEN 1 THEN string_split(line, '|')[2] END AS value, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS noisy FROM l")
def parse_legacy_kv(spark, sf):
    p, n = table(spark, sf, "part"), F.col("p_partkey").cast("string")
    lines = [F.concat_ws("|", n, "p_brand", "p_name", F.lit("z")), F.concat_ws("|", "p_type", "p_name"), F.col("p_name")]
    rows = p.select("p_partkey", F.element_at(F.array(*lines), (F.col("p_partkey") % 3 + 1).cast("int")).alias("line")).withColumn("kv", S.parse_legacy_kv(F.col("line")))
    return rows.select("p_partkey", F.array_join("kv.keys", "/").alias("keys"), "kv.value", "kv.noisy")


@query(f"SELECT p_partkey + 1 AS id, array_to_string(list_distinct([{ek('p_brand')}]) || list_filter([{ek('p_type')}, 'size_' || p_size], lambda x: x <> {ek('p_brand')}), '/') AS keys, 'part/' || p_partkey AS value FROM part")
def feed_table(spark, sf):
    return T.parts_lines(spark, sf).select("id", F.array_join("keys", "/").alias("keys"), "value")


@query("SELECT doc_id, line AS value FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''")
def feed_lines(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return d.select("doc_id", S.feed_values(F.col("line")).alias("value")).where("value IS NOT NULL")


@query(T.WITH_ORDERS + "SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE ts END AS ts, array_to_string(keys, ' ') AS keys, value FROM lines")
def read_store_text(spark, sf):
    """Orders, a third of them undated, written as store lines in the shared folder, read and parsed again."""
    lines = T.orders_lines(spark, sf).withColumn("ts", F.when(F.col("id") % 3 == 0, "").otherwise(F.col("ts")))
    path = fresh(spark, "store")
    write_store(lines, path)
    return S.parse_lines(S.read_text(spark, path))[0].select("id", "ts", F.array_join("keys", " ").alias("keys"), "value")




@query(f"SELECT value, {T.FNV} AS hash FROM (SELECT 'order/' || o_orderkey AS value FROM orders)")
def content_hash(spark, sf):
    value = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select(value.alias("value"), X.content_hash(value).alias("hash"))


_BUNDLES = """WITH b AS (SELECT *, CASE WHEN text IS NULL THEN 'damaged' WHEN doc_id % 10 = 0 THEN 'newer' WHEN doc_id % 11 = 0 AND text <> '' THEN 'damaged' ELSE 'ok' END AS status FROM documents)
SELECT 'b/' || doc_id AS path, status, CASE WHEN status = 'ok' THEN rpad(hex(source), 32, '0') END AS nonce, CASE WHEN status = 'ok' THEN doc_id END AS seq FROM b"""


@query(_BUNDLES)
def read_bundles(spark, sf):
    """Documents framed as bundles, a part of them damaged or newer, classified."""
    d = table(spark, sf, "documents").withColumn("body", F.encode("text", "UTF-8"))
    pad = lambda x, n: F.lpad(F.hex(x), n, "0")
    version = F.when(F.col("doc_id") % 10 == 0, "02").otherwise("01")
    crc = F.when(F.col("doc_id") % 11 == 0, F.lit(0).cast("long")).otherwise(F.crc32("body"))
    head = F.unhex(F.concat(F.hex(F.lit("AISB")), version, F.rpad(F.hex(F.encode(F.col("source"), "UTF-8")), 32, "0"), pad(F.col("doc_id"), 16), pad(F.octet_length("body").cast("long"), 8), pad(crc, 8)))
    files = d.select(F.concat(F.lit("b/"), "doc_id").alias("path"), F.concat(head, "body").alias("content"))
    return S.check_bundles(files).select("path", "status", "nonce", "seq")
