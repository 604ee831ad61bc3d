"""Column functions over keys, values and timestamps."""

from __future__ import annotations

from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Fixed values of the record format.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
BLANKED = "".join(map(chr, range(0x21))) + "\x7f|/\\"
KEY_BYTES = 511
QUERY_KEYS = 64
LINE_BYTES = 65536
WIRE_BYTES = 41
INLINE_BYTES = 65536
SECRET = "aisc:"
FNV_BASIS = 1469598103934665603
FNV_PRIME = 1099511628211
#: Visible ASCII without bars and slashes, and no leading dot.
PLAIN_KEY = r"^(?!\.)[\x21-\x2E0-\x5B\x5D-\x7B\x7D\x7E]+\z"
#: What a line's end loses.
LINE_BLANKS = "\n\r \t"
TS_SHAPE = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}Z?)?)?$"


def key_encode(key: Column) -> Column:
    """The form in which keys are compared.

    ASCII letters in lower case; blanks, bars, slashes, backslashes and control characters as underscores, a leading dot too;
    other characters untouched; at most KEY_BYTES bytes, cut between characters.
    """
    # Most keys need their letters folded only, which costs a twentieth of what the general form does.
    plain = (F.octet_length(key) <= KEY_BYTES) & key.rlike(PLAIN_KEY)
    folded = F.translate(key, UPPER + BLANKED, LOWER + "_" * len(BLANKED))
    folded = F.when(folded.startswith("."), F.concat(F.lit("_"), F.substring(folded, 2, 1 << 30))).otherwise(folded)
    cut = F.make_valid_utf8(F.substring(F.encode(folded, "UTF-8"), 1, KEY_BYTES).cast("string"))
    whole = F.when(F.octet_length(folded) > KEY_BYTES, F.regexp_replace(cut, "�+$", "")).otherwise(folded)
    return F.when(plain, F.lower(key)).otherwise(whole)


def key_prefix(key: Column) -> Column:
    """Shard of an encoded key: two characters if the first is ASCII, else one."""
    return F.when(F.ascii(key) < 128, F.substring(key, 1, 2)).otherwise(F.substring(key, 1, 1))


def key_fold_stored(key: Column) -> Column:
    """A key as it is stored: bars and control characters become underscores."""
    return F.regexp_replace(key, r"[\x00-\x1F|]", "_")


def tokenise_keys(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t]+"), lambda x: x != "")


def normalise_typed(text: Column) -> Column:
    """Keys as a person types them: commas part like blanks, which collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ",", " "), r"\s+", " "))


def stamp(as_of: datetime) -> Column:
    """A job's own time in UTC, to the second, as records carry it; a parameter, so that a rerun gives the same."""
    return F.lit(as_of.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))


def is_detach(key: Column) -> Column:
    return key.startswith("-") & (F.length(key) > 1)


def attaches(keys: Column) -> Column:
    return F.filter(keys, lambda k: ~is_detach(k))


def detaches(keys: Column) -> Column:
    return F.transform(F.filter(keys, is_detach), lambda k: F.substring(k, 2, 1 << 20))


def keys_union(a: Column, b: Column) -> Column:
    """Both key lists, the first spelling of each encoded key, in order."""
    both = F.concat(a, b)
    coded = F.transform(both, key_encode)
    bound = F.transform(F.array(F.struct(both.alias("k"), coded.alias("e"))), lambda s: F.filter(s["k"], lambda k, i: F.array_position(s["e"], key_encode(k)) == i + 1))
    return bound[0]


def keys_contain(keys: Column, key: Column) -> Column:
    return F.array_contains(F.transform(keys, key_encode), key_encode(key))


def key_diff(new: Column, old: Column) -> Column:
    """The edits that make old to new: -k for what goes, k for what comes."""
    return F.concat(F.transform(F.array_except(old, new), lambda k: F.concat(F.lit("-"), k)), F.array_except(new, old))


def looks_like_ts(text: Column) -> Column:
    return text.rlike(TS_SHAPE)


def ts_next_second(ts: Column) -> Column:
    """One second on, for full timestamps; null for anything else."""
    at = F.try_to_timestamp(ts, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(looks_like_ts(ts) & (F.length(ts) == 20), F.date_format(at + F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


@F.arrow_udf(LongType())
def _fnv(values: pa.Array) -> pa.Array:
    """The hash of many values at once, a byte of each in turn; the longest go first, so that those with a byte left are a prefix."""
    wide = np.int64 if pa.types.is_large_string(values.type) else np.int32
    _, ends, held = values.buffers()
    ends = np.frombuffer(ends, wide)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    held = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    starts, left = ends[:-1][order], -sizes[order]
    hashes = np.full(len(values), FNV_BASIS, np.uint64)
    for at in range(-int(left[0]) if len(left) else 0):
        n = np.searchsorted(left, -at)
        hashes[:n] = (hashes[:n] ^ held[starts[:n] + at]) * np.uint64(FNV_PRIME)
    out = np.empty_like(hashes)
    out[order] = hashes
    return pa.array(out.view(np.int64), mask=np.asarray(values.is_null()))


def content_hash(value: Column) -> Column:
    """16 hex digits: the 64-bit xor-multiply hash of the value's bytes from FNV_BASIS."""
    return F.lower(F.lpad(F.hex(_fnv(value.cast("string"))), 16, "0"))


def in_date_range(ts: Column, first: str | None, last: str | None) -> Column:
    """By the first ten characters, inclusive; a record without a date fails any bound."""
    day = F.substring(ts, 1, 10)
    ok = F.lit(True)
    if first or last:
        ok = F.length(F.coalesce(ts, F.lit(""))) > 0
    if first:
        ok = ok & (day >= first[:10])
    if last:
        ok = ok & (day <= last[:10])
    return ok


def value_kind(value: Column) -> Column:
    return (
        F.when(value.startswith(SECRET + "@"), "secret_blob")
        .when(value.startswith(SECRET), "secret_inline")
        .when(value.startswith("blobs/"), "blob_ref")
        .when(value.rlike("^https?://"), "url")
        .when(value.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^ ]"), "uri")
        .when(value.startswith("/"), "abs_path")
        .when(value.rlike(r"^[^ ]+/[^ ]*$"), "rel_path")
        .otherwise("text")
    )


def has_interior_newline(value: Column) -> Column:
    """Whether text follows a line break. A pattern would read on to the end from every line break of a blank end."""
    return trim_line(value).contains("\n")


def trim_line(value: Column) -> Column:
    # In a pattern $ would also stand before a last line separator.
    return F.rtrim(value, F.lit(LINE_BLANKS))


def preview(body: Column, value: Column, cap: int) -> Column:
    shown = F.when(F.length(body) > cap, F.concat(F.substring(body, 1, cap), F.lit("…"))).otherwise(body)
    return F.coalesce(shown, value)


def snippet(value: Column, size: int = 68) -> Column:
    return F.when(F.length(value) > size, F.concat(F.substring(value, 1, size), F.lit("..."))).otherwise(value)


def approx_tokens_log(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(F.length(text) / 4))


def approx_tokens_bytes(text: Column) -> Column:
    return F.floor(F.octet_length(text) / 4)


def safe_num(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def date_facets(date: Column, extra: list[str]) -> Column:
    return F.concat(F.array(F.date_format(date, "yyyy"), F.date_format(date, "yyyy-MM-dd")), F.array(*map(F.lit, extra)).cast("array<string>"))


def with_project(keys: Column, project: str) -> Column:
    return F.concat(F.array(F.lit(project)), keys)


def safe_path(path: Column) -> Column:
    """A document's own place: one name under blobs/, nothing above it."""
    return path.rlike(r"^blobs/[^/\\]+$") & ~path.contains("..")


def write_reason(keys: Column, value: Column) -> Column:
    """Why a record would be refused; null if it is fine."""
    wire = F.octet_length(value) + WIRE_BYTES
    line = F.octet_length(value) + F.octet_length(F.array_join(keys, " "))
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(value.contains("\x00"), "nul")
        .when(value.rlike("[\r\n]"), "newline")
        .when(F.exists(keys, lambda k: F.octet_length(k) > KEY_BYTES + 1), "key_too_long")
        .when(line >= LINE_BYTES, "line_too_long")
        .when(wire >= LINE_BYTES, "wire_too_long")
    )
