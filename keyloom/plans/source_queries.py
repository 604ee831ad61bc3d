"""Readers and sinks over files that the queries write from the given tables, and folder merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts as C
from ..operators import lattice as L
from ..operators import merge as M
from ..operators import upsert as U
from ..operators import views
from ..scratch import fresh, saved
from ..session import table
from ..sources import readers as S
from ..sources import sinks as K
from ..streaming import streams
from . import tables as T
from .registry import query

W = T.WITH_ORDERS


def _written(rows, spark, label: str) -> str:
    """The folder of a column of lines, written as text."""
    path = fresh(spark, label)
    rows.write.text(path)
    return path


@query(W + "SELECT id, CASE WHEN id % 34 = 0 THEN ts ELSE '' END AS ts, hash FROM tomb")
def read_tomb(spark, sf):
    """Tombstones as id|ts|hash, or the old form, an id alone."""
    line = F.when(F.col("hash") != "", F.concat_ws("|", F.col("id").cast("string"), "ts", "hash")).otherwise(F.col("id").cast("string"))
    path = _written(T.orders_state(spark, sf).tomb.select(line), spark, "tomb")
    return S.parse_tomb(S.read_text(spark, path)).select("id", "ts", "hash")


@query(W + "SELECT id, CASE WHEN id % 22 = 0 THEN ts ELSE '' END AS ts, hash, key FROM ktomb WHERE id % 33 <> 0")
def read_key_facts(spark, sf):
    """Key tombstones as id|ts|hash|key or the old form id|key; lines of three fields are no entries."""
    n = F.col("id").cast("string")
    line = F.when(F.col("id") % 33 == 0, F.concat_ws("|", n, "ts", "key")).when(F.col("hash") != "", F.concat_ws("|", n, "ts", "hash", "key")).otherwise(F.concat_ws("|", n, "key"))
    path = _written(T.orders_state(spark, sf).ktomb.select(line), spark, "ktomb")
    return S.parse_key_facts(S.read_text(spark, path)).select("id", "ts", "hash", "key")


@query("SELECT 'c' || (o_orderkey // 500) AS path, o_orderkey % 500 AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 500 > 0 AND o_orderkey // 500 % 7 <> 6")
def read_clock(spark, sf):
    """Clock files of 500 slots, of which two thirds are blank; every seventh file has a byte too many and is none."""
    o = table(spark, sf, "orders").where("o_orderkey % 3 = 0")
    slot = F.struct((F.col("o_orderkey") % 500).alias("k"), F.date_format("o_orderdate", T.ISO).alias("ts"))
    files = o.groupBy(F.floor(F.col("o_orderkey") / 500).alias("n")).agg(F.map_from_entries(F.collect_set(slot)).alias("slots"))  # 500 at most
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: F.concat(F.coalesce(F.try_element_at("slots", k.cast("long")), F.lit(" " * 20)), F.lit("\n"))), "")
    text = F.concat(text, F.when(F.col("n") % 7 == 6, "x").otherwise(""))
    return S.parse_clocks(files.select(F.concat(F.lit("c"), "n").alias("path"), F.encode(text, "UTF-8").alias("content")))


@query("SELECT CASE doc_id % 4 WHEN 0 THEN 'bundle' WHEN 1 THEN 'reject' ELSE 'stream' END AS kind, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1")
def read_container(spark, sf):
    head = F.when(F.col("doc_id") % 4 == 0, F.lit(bytearray(b"\x01"))).when(F.col("doc_id") % 4 == 1, F.lit(bytearray(b"\x05"))).when(F.col("doc_id") % 4 == 2, F.lit(bytearray(b"\n"))).otherwise(F.lit(bytearray(b"A")))
    d = table(spark, sf, "documents").where("text <> ''").select(F.concat(head, F.encode("text", "UTF-8")).alias("content"))
    return d.groupBy(S.container_kind(F.col("content")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sum(strlen(p_name) + 1)::BIGINT AS bytes FROM part")
def read_blobs(spark, sf):
    path = _written(table(spark, sf, "part").select("p_name"), spark, "blobs")
    blobs = S.read_blobs(spark, path).where(F.col("path").rlike("^blobs/part-"))
    return blobs.agg(F.sum("length").alias("bytes"))


@query("SELECT 'd' || doc_id AS nonce, 'blobs/' || doc_id || '.txt' AS path, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def embedded_bodies(spark, sf):
    """A body in each payload, behind and before fact lines; its length and not its lines tells where it ends."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    head = F.concat(F.lit("A|2020-01-01T00:00:00Z|k|v\nB|blobs/"), F.col("doc_id").cast("string"), F.lit(".txt|"), F.octet_length("text").cast("string"), F.lit("\n"))
    payload = F.encode(F.concat(head, "text", F.lit("\nD|2021-01-01T00:00:00Z|h\n")), "UTF-8")
    bodies = S.embedded_bodies(d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("nonce"), payload.alias("payload")))
    return bodies.select("nonce", "path", F.md5("content").alias("digest"))


@query("SELECT trim(p_name) AS value, count(*) AS n FROM part WHERE p_partkey % 10 > 1 AND trim(p_name) <> '' GROUP BY 1")
def read_index_tree(spark, sf):
    """Values of a tree of files; a blank and a comment line in every ten are none."""
    n = F.col("p_partkey") % 10
    line = F.when(n == 0, F.lit("  ")).when(n == 1, F.concat(F.lit("# "), "p_name")).otherwise(F.concat(F.lit(" "), "p_name"))
    path = _written(table(spark, sf, "part").select(line), spark, "tree")
    return S.read_index_tree(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query(T.WITH_TRIALS + "SELECT qid, arm, root, root_files, total_tokens, correct, recall FROM trials")
def read_trials(spark, sf):
    """Trials written as CSV without their free text, and read again."""
    path = fresh(spark, "trials")
    K.sanitised(T.trials(spark, sf).withColumn("answer", F.lit("x"))).write.csv(path, header=True)
    return S.read_trials(spark, path).select("qid", "arm", "root", "root_files", "total_tokens", F.coalesce("correct", F.lit("")).alias("correct"), "recall")


@query("SELECT conv_id || '/' || turn AS id, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN role || ',x' ELSE '' END AS expect FROM conversations")
def read_questions(spark, sf):
    """Expectations as a string, as a list, and none."""
    expect = F.when(F.col("turn") % 3 == 0, F.col("role")).when(F.col("turn") % 3 == 1, F.to_json(F.array("role", F.lit("x"))))
    raw = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("question"), expect.alias("expect"))
    return S.parse_questions(raw).select("id", F.array_join("expect", ",").alias("expect"))


@query("SELECT role AS tool, coalesce(length(text), 0)::BIGINT AS chars, turn * 10.0::DOUBLE AS latency_ms, count(*) AS n FROM conversations GROUP BY ALL")
def read_tool_log(spark, sf):
    path = fresh(spark, "log")
    c = table(spark, sf, "conversations")
    c.select(F.col("role").alias("tool"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), (F.col("turn") * 10.0).alias("latency_ms")).write.json(path)
    return S.read_tool_log(spark, path).groupBy("tool", "chars", "latency_ms").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name AS text, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1")
def read_corpus(spark, sf):
    """A tree with a folder that is left out."""
    path = fresh(spark, "corpus")
    table(spark, sf, "part").select(F.when(F.col("p_size") % 2 == 0, "kept").otherwise(".git").alias("folder"), "p_name").write.partitionBy("folder").text(path)
    return S.read_corpus(spark, path, ["folder=.git"]).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(W + "SELECT id, CASE WHEN id % 2 = 0 THEN '2024-05-05T10:00:00Z' ELSE ts END AS ts FROM base")
def as_of_stamp(spark, sf):
    """Records without a time get the job's, given in another zone."""
    from datetime import datetime, timedelta, timezone

    at = X.stamp(datetime(2024, 5, 5, 12, tzinfo=timezone(timedelta(hours=2))))
    return T.orders_lines(spark, sf).where("ord = 0").select("id", F.when(F.col("id") % 2 == 0, at).otherwise(F.col("ts")).alias("ts"))


@query(W + "SELECT section, count(*) AS n FROM (SELECT 0 AS section FROM firsts UNION ALL SELECT 0 FROM firsts f JOIN sts s USING (id) WHERE s.ts > f.ts UNION ALL SELECT 0 FROM shown WHERE ord > 0 UNION ALL SELECT 1 FROM tomb WHERE hash <> '' UNION ALL SELECT 2 FROM ktomb WHERE hash <> '' UNION ALL SELECT 3 FROM katt) GROUP BY section")
def export_text(spark, sf):
    """An export written as lines and parsed as facts again, by the section that their verbs belong to."""
    path = fresh(spark, "export")
    K.write_export(T.orders_state(spark, sf), path)
    facts = S.parse_facts(S.read_text(spark, path), "").where("status = 'fact'")
    section = F.when(F.col("verb") == "D", 1).when(F.col("verb") == "K", 2).when(F.col("verb") == "T", 3).otherwise(0)
    return facts.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query(W + "SELECT id, array_to_string(keys, ' ') AS keys, value FROM shown")
def dump_text(spark, sf):
    """A dump written as KEY... -v VALUE and parsed again; ids are those of the lines' values."""
    path = fresh(spark, "dump")
    K.write_dump(T.orders_state(spark, sf), path)
    kv = S.read_text(spark, path).select(S.parse_kv(F.col("line")).alias("kv"))
    return kv.select((F.regexp_extract("kv.value", r"^order/(\d+)", 1).cast("long") + 1).alias("id"), F.array_join("kv.keys", " ").alias("keys"), "kv.value")


# Devices are runs of 500 events; of each there is an older bundle, which tells less, and some are damaged or of a newer build.
_DEVICES = T.FACTS.replace("FROM events)", "FROM events WHERE event_id // 500 % 10 <> 3 AND event_id // 500 % 11 <> 5)")


def _folder(spark, sf):
    """(path, content): a bundle of each device's facts as lines, and an older one."""
    e = T.event_facts(spark, sf).withColumn("n", F.floor(F.col("seq") / 500))
    line = (
        F.when(F.col("verb") == "A", F.concat_ws("|", "verb", "ts", F.array_join("keys", " "), "value"))
        .when(F.col("verb") == "D", F.concat_ws("|", "verb", "ts", X.content_hash(F.col("hash"))))
        .otherwise(F.concat_ws("|", "verb", "ts", X.content_hash(F.col("hash")), "key"))
    )
    own = e.select("n", F.struct("seq", line.alias("line")).alias("s")).groupBy("n").agg(F.array_sort(F.collect_list("s"))["line"].alias("lines"))  # 500 at most
    older = own.select("n", F.lit(1).alias("seq"), F.slice("lines", 1, 20).alias("lines"))
    both = own.select("n", F.lit(2).alias("seq"), "lines").unionByName(older)
    body = F.encode(F.concat(F.array_join("lines", "\n"), F.lit("\n")), "UTF-8")
    pad = lambda c, size: F.lpad(F.hex(c.cast("long")), size, "0")
    rows = both.withColumn("body", body)
    version = F.when(F.col("n") % 10 == 3, "02").otherwise("01")
    crc = F.when(F.col("n") % 11 == 5, F.lit(0)).otherwise(F.crc32("body"))
    head = F.unhex(F.concat(F.hex(F.lit("AISB")), version, pad(F.col("n"), 32), pad(F.col("seq"), 16), pad(F.octet_length("body"), 8), pad(crc, 8)))
    return rows.select(F.concat_ws("/", F.lit("f"), "n", "seq").alias("path"), F.concat(head, "body").alias("content"))


@query("WITH d AS (SELECT DISTINCT event_id // 500 AS n FROM events) SELECT 2 * count(*) AS seen, 2 * count(*) FILTER (n % 10 <> 3 AND n % 11 <> 5) AS took, 2 * count(*) FILTER (n % 10 = 3) AS newer, 2 * count(*) FILTER (n % 10 <> 3 AND n % 11 = 5) AS bad FROM d")
def folder_report(spark, sf):
    return M.folder_report(S.check_bundles(_folder(spark, sf)))


@query("WITH " + _DEVICES + "," + T.CONVERGED + ", ks AS (SELECT rec, string_agg(key, ' ' ORDER BY key) AS keys FROM reckeys GROUP BY rec) SELECT value, coalesce(keys, '') AS keys FROM records LEFT JOIN ks USING (rec) WHERE live")
def folder_merge(spark, sf):
    """Every device's latest valid bundle, converged; records are named by their content hash."""
    return M.normal_state(M.merge_folder(S.check_bundles(_folder(spark, sf)), None, "2024-01-01T00:00:00Z"))


_TOLD = "WITH " + _DEVICES + "," + T.CONVERGED + f""", named AS (SELECT *, {T.FNV} AS name FROM (SELECT rec, coalesce(value, rec) AS value, add_ts, del_ts, live FROM records)),
atts AS (SELECT hash AS rec, coalesce(akey, key) AS key, max(ts) AS ts FROM facts WHERE verb IN ('A', 'T') GROUP BY ALL),
att AS (SELECT a.*, n.name, n.live AND a.ts = n.add_ts AS now FROM atts a JOIN named n USING (rec) WHERE n.del_ts IS NULL OR a.ts > n.del_ts),
own AS (SELECT rec, string_agg(key, ' ' ORDER BY key) AS keys FROM att WHERE now GROUP BY rec)
SELECT 0 AS section, 'A|' || add_ts || '|' || coalesce(keys, '') || '|' || value AS line FROM named LEFT JOIN own USING (rec) WHERE live
UNION ALL SELECT 1, 'D|' || del_ts || '|' || name FROM named WHERE del_ts IS NOT NULL
UNION ALL SELECT 2, 'K|' || max(f.ts) || '|' || n.name || '|' || f.key FROM facts f JOIN named n ON n.rec = f.hash WHERE f.verb = 'K' GROUP BY n.name, f.key
UNION ALL SELECT 3, 'T|' || ts || '|' || name || '|' || key FROM att WHERE NOT now OR now IS NULL"""


@query(_TOLD)
def folder_export(spark, sf):
    """The lines that a device tells after the pass."""
    return L.told_lines(L.folder_pass(S.check_bundles(_folder(spark, sf)), None, "2024-01-01T00:00:00Z")).select("section", "line")


@query("WITH " + _DEVICES + "," + T.CONVERGED + ", ks AS (SELECT rec, string_agg(key, ' ' ORDER BY key) AS keys FROM reckeys GROUP BY rec) SELECT value, coalesce(keys, '') AS keys FROM records LEFT JOIN ks USING (rec) WHERE live")
def folder_export_merge(spark, sf):
    """A new device that merges nothing but another one's export ends where that one did."""
    # An order over all rows reads them twice.
    told = saved(L.told_lines(L.folder_pass(S.check_bundles(_folder(spark, sf)), None, "2024-01-01T00:00:00Z")), "told")
    path = _written(told.orderBy("section", "id", "place").select("line"), spark, "told")
    facts = S.parse_facts(S.read_text(spark, path), "").where("status = 'fact'").withColumn("replica", F.lit("told")).withColumnRenamed("ord", "seq")
    named = facts.withColumn("hash", F.when(F.col("verb") == "A", X.content_hash(F.col("value"))).otherwise(F.col("hash")))
    return M.normal_state(M.converge(named))


_LINKS = """, m AS (SELECT o_orderkey AS seq, 'order/' || (o_orderkey // 2) AS head, CASE o_orderkey % 3 WHEN 0 THEN 'more/' || (o_orderkey % 700) WHEN 1 THEN 'order/' || (o_orderkey + 1) ELSE 'more/' || o_orderkey END AS value FROM orders),
good AS (SELECT m.seq, m.value, b.id, b.keys FROM m JOIN base b ON b.value = m.head WHERE b.id NOT IN (SELECT id FROM tomb) AND m.value NOT IN (SELECT value FROM lines)),
won AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY value ORDER BY seq, id) = 1) """


@query(W + _LINKS + "SELECT id, array_to_string(keys, ' ') AS keys, value FROM lines UNION ALL SELECT id, array_to_string(keys, ' '), value FROM won")
def import_links(spark, sf):
    """M facts by the content hash of their record's value, imported twice: the second time changes nothing."""
    s = T.orders_state(spark, sf)
    n = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    value = F.when(n % 3 == 0, F.concat(F.lit("more/"), text(n % 700))).when(n % 3 == 1, F.concat(F.lit("order/"), text(n + 1))).otherwise(F.concat(F.lit("more/"), text(n)))
    facts = table(spark, sf, "orders").select(n.alias("seq"), F.lit("M").alias("verb"), X.content_hash(F.concat(F.lit("order/"), text(F.floor(n / 2)))).alias("hash"), value.alias("value"))
    once = saved(C.import_links(s.lines, s.tomb, facts), "imported")
    return C.import_links(once, s.tomb, facts).select("id", F.array_join("keys", " ").alias("keys"), "value")


@query("SELECT doc_id AS id, md5(text) AS digest FROM documents WHERE regexp_matches(text, '\\n[\\s\\S]*[^\\n\\r \\t]') OR strlen(text) > 65536")
def stored_bodies(spark, sf):
    """Documents' bodies stored under their path, and found again by the value of their record."""
    split = U.split_documents(table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("value"), F.lit("2024-01-01").alias("ts")))
    moved = U.moved_documents(split)
    path = fresh(spark, "bodies")
    U.write_bodies(split, path, moved)
    # A stored body is hashed where it is read, so digests meet the lines and not texts.
    bodies = spark.read.schema("path string, body string").parquet(path).select("path", F.md5("body").alias("digest"))
    lines = U.placed_documents(split, moved).where("form = 'document'").select(F.col("seq").alias("id"), "value")
    return U.with_bodies(lines, bodies).select("id", "digest")


@query(W + ", back AS (SELECT id, value FROM base WHERE id % 68 = 0) SELECT id, hash FROM tomb WHERE id NOT IN (SELECT id FROM back) AND hash NOT IN (SELECT value FROM back)")
def revive(spark, sf):
    s = T.orders_state(spark, sf)
    back = s.lines.where("ord = 0 AND id % 68 = 0").select("id", F.col("value").alias("hash"))
    return U.revive(s.tomb, back).select("id", "hash")


@query(W + f", dead AS (SELECT {T.FNV} AS hash, ts FROM (SELECT *, 'gone/' || id AS value FROM tomb)), arrive AS (SELECT 'gone/' || (o_orderkey + 1) AS value, CASE WHEN o_orderkey % 2 = 0 THEN '2019-01-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS ts FROM orders) SELECT a.value, CASE WHEN d.hash IS NULL THEN 'new' WHEN a.ts > d.ts THEN 'back' ELSE 'dead' END AS status FROM (SELECT *, {T.FNV} AS hash FROM arrive) a LEFT JOIN dead d USING (hash)")
def put_vs_tomb_hash(spark, sf):
    """Arrivals whose line is gone meet their tombstone by content hash."""
    s = T.orders_state(spark, sf)
    tomb = s.tomb.withColumn("hash", X.content_hash(F.concat(F.lit("gone/"), F.col("id").cast("string"))))
    ts = F.when(F.col("o_orderkey") % 2 == 0, "2019-01-01T00:00:00Z").otherwise("2024-01-01T00:00:00Z")
    arrive = table(spark, sf, "orders").select(F.concat(F.lit("gone/"), (F.col("o_orderkey") + 1).cast("string")).alias("value"), ts.alias("ts"))
    return U.put_status(s.lines, tomb, arrive)


@query(W + "SELECT id, ts, array_to_string(keys, ' ') AS keys, value, row_number() OVER (PARTITION BY id ORDER BY ord) AS place FROM lines")
def stream_tail(spark, sf):
    """A store that grows by files, read as a stream; a record's links keep their order."""
    path = fresh(spark, "growing")
    K.write_store(T.orders_lines(spark, sf), path)
    out = streams.run_once(streams.tail(spark, path)[0], fresh(spark, "stream"), "append")
    return out.select("id", "ts", F.array_join("keys", " ").alias("keys"), "value", F.row_number().over(views.by_id()).cast("long").alias("place"))
