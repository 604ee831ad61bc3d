"""Idempotent bulk changes of the record tables; each returns new tables and leaves the old ones as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import attaches, content_hash, detaches, has_interior_newline, key_encode, key_fold_stored, safe_path, trim_line
from ..schema import State
from ..scratch import saved
from ..spread import dealt, parts_for
from . import views
from .recall import numbered


def _none():
    return F.array().cast("array<string>")


def merged_keys(rows: DataFrame) -> DataFrame:
    """(value, seq, ts, keys): arrivals (seq, value, keys, ts) by value, first arrival first, first spelling of each key.

    Keys are thinned per (value, key) before they are gathered, so a value that arrives in a third of all rows gathers its
    distinct keys only.
    """
    kept = rows.withColumn("keys", attaches("keys"))
    heads = kept.groupBy("value").agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))
    one = kept.select("value", "seq", F.posexplode("keys").alias("pos", "key"))
    one = one.groupBy("value", key_encode(F.col("key")).alias("ekey")).agg(F.min(F.struct("seq", "pos", "key")).alias("k")).where("ekey <> ''")
    keys = one.groupBy("value").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: key_fold_stored(k["key"])).alias("keys"))
    return heads.join(keys, "value", "left").select("value", "seq", "ts", F.coalesce("keys", _none()).alias("keys"))


def bulk_put(lines: DataFrame, incoming: DataFrame, start: int) -> DataFrame:
    """Lines after putting all arrivals (seq, value, keys, ts) at once.

    A value names one record: a known value gets the new keys at its first link, an unknown one becomes a record. New ids follow
    start in order of first arrival. Putting the same arrivals again changes nothing.
    """
    arrived = merged_keys(incoming.where("value IS NOT NULL AND value <> ''"))
    owners = lines.groupBy("value").agg(F.min("id").alias("owner"))
    known = arrived.join(owners, "value").select(F.col("owner").alias("id"), "seq", "keys")
    # A record may be met through several links: its new keys in arrival order.
    more = known.select("id", "seq", F.posexplode("keys").alias("pos", "key")).groupBy("id", key_encode(F.col("key")).alias("ekey")).agg(F.min(F.struct("seq", "pos", "key")).alias("k"))
    more = more.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("k")), lambda k: k["key"]).alias("more"))
    fresh = arrived.join(owners, "value", "left_anti")
    fresh = numbered(fresh, ["seq", "value"], start).select("id", "ts", "keys", "value", F.lit(0).cast("long").alias("ord"))
    old = lines.join(more, "id", "left")
    coded = F.transform("keys", key_encode)
    added = F.concat("keys", F.filter(F.coalesce("more", _none()), lambda k: ~F.array_contains(coded, key_encode(k))))
    first = F.row_number().over(views.by_id()) == 1
    old = old.withColumn("first", first).withColumn("keys", F.when(F.col("first"), added).otherwise(F.col("keys")))
    return old.select("id", "ts", "keys", "value", "ord").unionByName(fresh)


def put_status(lines: DataFrame, tomb: DataFrame, incoming: DataFrame) -> DataFrame:
    """(value, status) of arrivals (value, ts) against tombstones.

    known: a live record holds it; new: nobody did; back: it was deleted and comes back, being newer than the
    delete or without a time; dead: it stays deleted. A delete is met by id, or by hash where the line is gone.
    """
    dead_ids = views.latest(tomb, ["id"]).select("id", F.col("ts").alias("del_id"))
    dead_hash = views.latest(tomb.where("hash <> ''"), ["hash"]).select("hash", F.col("ts").alias("del_hash"))
    held = lines.groupBy("value").agg(F.min("id").alias("id")).join(dead_ids, "id", "left")
    asked = incoming.groupBy("value").agg(F.max(F.when(F.col("ts").isNull(), F.lit("~")).otherwise(F.col("ts"))).alias("ts"))
    out = asked.join(held, "value", "left").withColumn("hash", F.when(F.col("id").isNull(), content_hash(F.col("value")))).join(dead_hash, "hash", "left")
    gone = F.coalesce("del_id", "del_hash")
    status = F.when(gone.isNull(), F.when(F.col("id").isNull(), "new").otherwise("known")).when(F.col("ts") > gone, "back").otherwise("dead")
    return out.select("value", status.alias("status"))


def revive(tomb: DataFrame, back: DataFrame) -> DataFrame:
    """Tombstones less those of values that came back, by id and by hash."""
    ids = back.where("id IS NOT NULL").select("id").distinct()
    hashes = back.where("hash IS NOT NULL").select("hash").distinct()
    return tomb.join(ids, "id", "left_anti").join(hashes, "hash", "left_anti")


def add_link(lines: DataFrame, tomb: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, value, status) of further links asked for: 0 added, 1 already there, -1 no such live record, -2 another record's value."""
    alive = views.live(lines, tomb).select("id").distinct().withColumn("alive", F.lit(True))
    owners = lines.groupBy("value").agg(F.min("id").alias("owner"))
    out = asked.join(alive, "id", "left").join(owners, "value", "left")
    status = F.when(F.col("alive").isNull(), -1).when(F.col("owner") == F.col("id"), 1).when(F.col("owner").isNotNull(), -2).otherwise(0)
    first = F.row_number().over(Window.partitionBy("value").orderBy("id"))
    out = out.withColumn("status", status).withColumn("turn", F.when(F.col("status") == 0, first))
    # Of two records that ask for one new value, the first gets it.
    return out.select("id", "value", F.when(F.col("turn") > 1, -2).otherwise(F.col("status")).alias("status"))


def last_edits(edits: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, key, op, seq, ever): the last edit of each (id, encoded key), and whether any attached it; -k detaches, k attaches."""
    both = edits.select("id", "seq", F.explode(F.concat(F.transform(attaches("keys"), lambda k: F.struct(key_encode(k).alias("key"), F.lit(False).alias("off"))), F.transform(detaches("keys"), lambda k: F.struct(key_encode(k).alias("key"), F.lit(True).alias("off"))))).alias("e"))
    both = dealt(both.select("id", "seq", "e.*").where("key <> ''"), parts, "id", "key")
    # Maxima of numbers are hashed, not sorted.
    ends = [f(F.when(F.col("off") == off, c)).alias(n) for off, side in ((False, "on"), (True, "off")) for f, c, n in ((F.max, F.col("seq"), f"{side}_seq"), (F.count, F.lit(1), f"{side}_n"))]
    m = both.groupBy("id", "key").agg(*ends)
    # Of edits with one number, a detachment goes last.
    detach = (F.col("off_n") > 0) & ((F.col("on_n") == 0) | F.coalesce(F.col("off_seq") >= F.col("on_seq"), F.col("on_seq").isNull()))
    return m.select("id", "key", F.when(detach, "detach").otherwise("attach").alias("op"), F.greatest("on_seq", "off_seq").alias("seq"), (F.col("on_n") > 0).alias("ever"))


def update_keys(lines: DataFrame, tomb: DataFrame, ktomb: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, ktomb) after edits (id, seq, keys). A detached key stays in the line and is hidden by ktomb."""
    parts = parts_for(lines, edits)
    lines = dealt(lines, parts, "id")
    last = dealt(last_edits(edits, parts), parts, "id").join(views.live(lines, tomb).select("id").distinct(), "id", "left_semi")
    return _with_keys(lines, last.where("op = 'attach'")), _hidden(ktomb, last, parts)


def _with_keys(lines: DataFrame, attached: DataFrame) -> DataFrame:
    """Lines with the attached (id, key, seq) at each record's first link."""
    more = attached.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "key"))), lambda k: k["key"]).alias("more"))
    coded = F.transform("keys", key_encode)
    added = F.concat("keys", F.filter(F.coalesce("more", _none()), lambda k: ~F.array_contains(coded, k)))
    first = F.row_number().over(views.by_id()) == 1
    out = lines.join(more, "id", "left").withColumn("first", first).withColumn("keys", F.when(F.col("first"), added).otherwise(F.col("keys")))
    return out.select("id", "ts", "keys", "value", "ord")


def _hidden(ktomb: DataFrame, last: DataFrame, parts: int | None) -> DataFrame:
    """(id, key) of ktomb after the last edits."""
    attached, detached = (last.where(F.col("op") == op).select("id", "key") for op in ("attach", "detach"))
    kept = dealt(ktomb.select("id", key_encode(F.col("key")).alias("key")), parts, "id", "key").join(attached, ["id", "key"], "left_anti")
    return dealt(kept.unionByName(detached), parts, "id", "key").distinct()


def set_value(lines: DataFrame, tomb: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, old, new, status) of edits (id, old, new): 0 replaced, -1 no such live link, -2 another record's value, -3 a text of lines."""
    alive = views.live(lines, tomb).select("id", F.col("value").alias("old")).distinct().withColumn("there", F.lit(True))
    owners = lines.groupBy(F.col("value").alias("new")).agg(F.min("id").alias("owner"))
    out = edits.join(alive, ["id", "old"], "left").join(owners, "new", "left")
    status = F.when(F.col("new").rlike("[\r\n]"), -3).when(F.col("there").isNull(), -1).when(F.col("owner").isNotNull() & (F.col("owner") != F.col("id")), -2).otherwise(0)
    return out.select("id", "old", "new", status.alias("status"))


def apply_set_value(lines: DataFrame, done: DataFrame) -> DataFrame:
    """Lines with accepted replacements; of equal links only the first changes."""
    nth = F.row_number().over(Window.partitionBy("id", "value").orderBy("ord"))
    new = done.where("status = 0").select("id", F.col("old").alias("value"), "new").dropDuplicates(["id", "value"])
    out = lines.withColumn("nth", nth).join(new, ["id", "value"], "left")
    return out.select("id", "ts", "keys", F.when(F.col("nth") == 1, F.coalesce("new", "value")).otherwise(F.col("value")).alias("value"), "ord")


def delete_ids(lines: DataFrame, tomb: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """Tombstones after deleting ids; the second delete of an id adds none."""
    parts = parts_for(lines)
    fresh = dealt(ids.select("id"), parts, "id").distinct().join(tomb.select("id").distinct(), "id", "left_anti")
    new = _stamped(lines, fresh, as_of, parts).select("id", "ts", "hash", "ord")
    return tomb.select("id", "ts", "hash", "ord").unionByName(new)


def _under(lines: DataFrame, key: str) -> DataFrame:
    """(id, key): records whose first link has the key, encoded."""
    coded = key_encode(F.lit(key))
    # Keys go through the window as one flag a line.
    has = lines.select("id", "ord", "value", F.array_contains(F.transform("keys", key_encode), coded).alias("has"))
    return views.first_link(has).where("has").select("id", coded.alias("key"))


def delete_under(lines: DataFrame, tomb: DataFrame, key: str, as_of: str) -> DataFrame:
    """(id, ts, counted): the tombstones of all records under a key; those already dead are stamped anew and not counted."""
    under = _under(dealt(lines, parts_for(lines), "id"), key).select("id")
    dead = tomb.select("id").distinct().withColumn("dead", F.lit(True))
    return under.join(dead, "id", "left").select("id", F.lit(as_of).alias("ts"), F.col("dead").isNull().alias("counted"))


def untag(lines: DataFrame, ktomb: DataFrame, key: str) -> DataFrame:
    """(id, key): key tombstones after taking a key off every record, dead ones too; records stay."""
    under = _under(dealt(lines, parts_for(lines), "id"), key)
    return ktomb.select("id", key_encode(F.col("key")).alias("key")).unionByName(under).distinct()


def _stamped(lines: DataFrame, rows: DataFrame, as_of: str, parts: int | None = None) -> DataFrame:
    """Rows (id, ...) with ts, the content hash of the record's value and no ord."""
    # Only the records of rows are ordered and hashed.
    named = dealt(lines.select("id", "value", "ord"), parts, "id").join(dealt(rows.select("id"), parts, "id").distinct(), "id", "left_semi")
    hashes = views.first_link(named).select("id", content_hash(F.col("value")).alias("hash"))
    return rows.join(hashes, "id").withColumn("ts", F.lit(as_of)).withColumn("ord", F.lit(None).cast("long"))


def _without(facts: DataFrame, keys: DataFrame, parts: int | None = None) -> DataFrame:
    """Key facts but those of (id, encoded key)."""
    coded = dealt(facts.withColumn("ekey", key_encode(F.col("key"))), parts, "id", "ekey")
    return coded.join(dealt(keys.select("id", F.col("key").alias("ekey")), parts, "id", "ekey").distinct(), ["id", "ekey"], "left_anti").drop("ekey")


def _clock(mts: DataFrame, ids: DataFrame, as_of: str, parts: int | None = None) -> DataFrame:
    return dealt(mts, parts, "id").join(ids, "id", "left_anti").unionByName(ids.select("id", F.lit(as_of).alias("ts")))


def _new_off(state: State, keys: DataFrame, parts: int | None) -> DataFrame:
    """Those of (id, encoded key) that have no entry in ktomb: a key that is off already keeps its own."""
    coded = dealt(state.ktomb.select("id", key_encode(F.col("key")).alias("key")), parts, "id", "key").distinct()
    return dealt(keys, parts, "id", "key").join(coded, ["id", "key"], "left_anti")


def edit_state(state: State, edits: DataFrame, as_of: str) -> State:
    """The whole state after update_keys: entries of ktomb and katt keep or get ts and hash, so that they travel, and mts is stamped."""
    parts = parts_for(state.lines, edits)
    alive = views.live(dealt(state.lines, parts, "id"), state.tomb).select("id").distinct()
    # The last edits, and what they add, are kept: several tables read them.
    last = saved(dealt(last_edits(edits, parts), parts, "id").join(alive, "id", "left_semi"), "edits")
    attached, detached = (last.where(F.col("op") == op).select("id", "key") for op in ("attach", "detach"))
    # An attachment clears the old entry, so a detachment after it in the same edits makes a new one.
    base = state._replace(ktomb=_without(state.ktomb, last.where("ever"), parts))
    new = attached.withColumn("op", F.lit("attach")).unionByName(_new_off(base, detached, parts).withColumn("op", F.lit("detach")))
    new = saved(_stamped(state.lines, new, as_of, parts), "stamped")
    on, off = (new.where(F.col("op") == op).drop("op") for op in ("attach", "detach"))
    edited = dealt(edits.select("id"), parts, "id").distinct().join(alive, "id", "left_semi")
    lines = _with_keys(dealt(state.lines, parts, "id"), dealt(last.where("op = 'attach'"), parts, "id"))
    katt = _without(state.katt, last, parts).unionByName(on)
    return state._replace(lines=lines, ktomb=base.ktomb.unionByName(off), katt=katt, mts=_clock(state.mts, edited, as_of, parts))


def set_value_state(state: State, edits: DataFrame, as_of: str) -> State:
    """The whole state after the accepted ones of edits (id, old, new); they stamp the edit clock."""
    done = set_value(state.lines, state.tomb, edits).where("status = 0")
    return state._replace(lines=apply_set_value(state.lines, done), mts=_clock(state.mts, done.select("id").distinct(), as_of))


def delete_ids_state(state: State, ids: DataFrame, as_of: str) -> State:
    """The whole state after delete_ids: clocks and attachments of the records that it deletes are cleared."""
    gone = ids.select("id").distinct().join(state.tomb.select("id").distinct(), "id", "left_anti").join(state.lines.select("id").distinct(), "id", "left_semi")
    off = lambda df: df.join(gone, "id", "left_anti")
    return state._replace(tomb=delete_ids(state.lines, state.tomb, ids, as_of), katt=off(state.katt), mts=off(state.mts), sts=off(state.sts))


def delete_under_state(state: State, key: str, as_of: str) -> State:
    """The whole state after delete_under: one new tombstone per record under key, clocks and attachments of those records cleared."""
    parts = parts_for(state.lines)
    ids = saved(_under(dealt(state.lines, parts, "id"), key).select("id"), "under")
    off = lambda df: dealt(df, parts, "id").join(ids, "id", "left_anti")
    return state._replace(tomb=off(state.tomb).unionByName(_stamped(state.lines, ids, as_of, parts)), katt=off(state.katt), mts=off(state.mts), sts=off(state.sts))


def untag_state(state: State, key: str, as_of: str) -> State:
    """The whole state after untag; the edit clock of live records is stamped."""
    parts = parts_for(state.lines)
    under = saved(_under(dealt(state.lines, parts, "id"), key), "under")
    ktomb = state.ktomb.unionByName(_stamped(state.lines, _new_off(state, under, parts), as_of, parts))
    edited = dealt(under.select("id"), parts, "id").join(state.tomb.select("id").distinct(), "id", "left_anti")
    return state._replace(ktomb=ktomb, katt=_without(state.katt, under, parts), mts=_clock(state.mts, edited, as_of, parts))


def compact(lines: DataFrame, tomb: DataFrame, ktomb: DataFrame) -> DataFrame:
    """Lines of live records with visible keys only."""
    return views.shown(lines, tomb, ktomb).select("id", "ts", "keys", "value", "ord")


def compact_facts(tomb: DataFrame, ktomb: DataFrame, katt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stays of tombstones and attachments: those that a hash lets travel, and attachments of live records and keys."""
    keep = katt.join(tomb.select("id").distinct(), "id", "left_anti").join(ktomb.select("id", "key").distinct(), ["id", "key"], "left_anti")
    return tomb.where("hash <> ''"), ktomb.where("hash <> ''"), keep


def purge(tomb: DataFrame) -> DataFrame:
    """Tombstones that no longer travel: their hashes are blank."""
    return tomb.withColumn("hash", F.lit(""))


def split_documents(rows: DataFrame) -> DataFrame:
    """(seq, form, value, body) of arrivals (seq, value, ts): inline lines, or documents with a path by content.

    A value with text after a line break, or over 64 KB, is a document; else its end is trimmed and an empty one refused.
    """
    # By size first: a long text needs no look inside.
    big = (F.octet_length("value") > 65536) | has_interior_newline(F.col("value"))
    path = F.concat(F.lit("blobs/"), F.coalesce("ts", F.lit("")), F.lit("~"), F.substring(F.md5("value"), 1, 8), F.lit(".txt"))
    trimmed = trim_line(F.col("value"))
    form = F.when(big, "document").when(trimmed == "", "empty").otherwise("inline")
    return rows.select("seq", form.alias("form"), F.when(big, path).otherwise(trimmed).alias("value"), F.when(big, F.col("value")).alias("body"))


def _digested(split: DataFrame) -> DataFrame:
    return split.withColumn("digest", F.when(F.col("form") == "document", F.md5("body")))


def moved_documents(split: DataFrame) -> DataFrame:
    """(value, digest, nth): the bodies that another one with a smaller digest keeps from their path, and the number that they get instead.

    It is kept, as several readers meet it, and as small as the collisions of a tag of eight digits are few.
    """
    nth = F.row_number().over(Window.partitionBy("value").orderBy("digest"))
    paths = _digested(split.where("form = 'document'")).select("value", "digest").distinct()
    return saved(paths.withColumn("nth", nth).where("nth > 1"), "moved")


def _path(digested: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows (value, digest, ...) with the paths of moved_documents."""
    numbered_path = F.regexp_replace("value", r"\.txt$", F.concat(F.lit("-"), F.col("nth").cast("string"), F.lit(".txt")))
    return digested.join(moved, ["value", "digest"], "left").withColumn("value", F.when(F.col("nth").isNull(), F.col("value")).otherwise(numbered_path)).drop("nth")


def placed_documents(split: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """split_documents with a path for each body: of different bytes under one path the body with the smallest digest keeps it, and the others get a number, as in
    blobs/time~tag-2.txt. moved is moved_documents(split), if it is there already.
    """
    return _path(_digested(split), moved_documents(split) if moved is None else moved).select("seq", "form", "value", "body")


def write_bodies(rows: DataFrame, path: str, moved: DataFrame | None = None) -> None:
    """Bodies of placed_documents by their path, or of split_documents and moved_documents; one that arrives twice is kept once, as its path follows from its content."""
    bodies = _digested(rows.where("form = 'document'")).groupBy("value", "digest").agg(F.first("body").alias("body"))
    # Bodies are moved once: they lie by path and digest already when they meet their numbers.
    placed = bodies if moved is None else _path(bodies, moved)
    placed.select(F.col("value").alias("path"), "body").write.parquet(path)


def with_bodies(lines: DataFrame, bodies: DataFrame) -> DataFrame:
    """Lines with the columns of bodies (path, ...): the stored text that a line's value names, if any, or what is taken from it."""
    return lines.join(bodies.withColumnRenamed("path", "value"), "value", "left")


def discard_list(lines: DataFrame, tomb: DataFrame) -> DataFrame:
    """Bodies whose record was deleted and that no live record names; nothing outside blobs/."""
    alive = views.live(lines, tomb).select("value").distinct()
    dead = lines.join(tomb.select("id").distinct(), "id", "left_semi")
    return dead.where(safe_path(F.col("value"))).select("value").distinct().join(alive, "value", "left_anti")


def delete_pattern(rows: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows with `removed`: whether the pattern takes the line out."""
    return rows.withColumn("removed", F.coalesce(F.col(text).rlike(pattern), F.lit(False)))
