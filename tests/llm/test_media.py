import hashlib
import io
import math
import random
import wave
import zlib

import pytest

from keyloom.llm import media_columns as M


def want(text):
    """The contract by the standard library and plain Python."""
    raw = (text or "").encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    held = io.BytesIO()
    with wave.open(held, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(8000)
        f.writeframes(payload)
    media = held.getvalue()
    n = len(payload)
    mean = sum(payload) / n
    deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in payload) / n)
    changes = sum((x >= 128) != (y >= 128) for x, y in zip(payload, payload[1:])) / (n - 1)
    feature = f"mean={mean:.4f};std={deviation:.4f};zcr={changes:.6f};peak={max(payload)}"
    return len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def test_documents_come_back(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghé") for _ in range(5))
    base = " ".join(word() for _ in range(9000))
    texts = ["", None, "x" * 64, "x" * 63, base, base, base[:20_000] + "changed" + base[20_000:], "tail " + base[30_000:], "a" * 100_000, "é" * 33]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, base), (4, base), (4, "other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, *tuple(r)[1:]) for r in M.media_columns(frame).collect())
    assert got == sorted((-1 if i is None else i, *want(t)) for i, t in docs)


def test_cuts_survive_shifts():
    rnd = random.Random(2)
    raw = bytes(rnd.randrange(256) for _ in range(200_000))
    a, b = {d for d, _ in M.chunks(raw)}, {d for d, _ in M.chunks(b"some bytes in front" + raw)}
    assert len(a & b) > 0.9 * len(a)
    sizes = [len(c) for _, c in M.chunks(raw)]
    assert sum(sizes) == len(raw) and max(sizes) <= M.MAX_CHUNK and min(sizes[:-1]) >= M.MIN_CHUNK


def test_a_wrong_chunk_is_noticed(spark):
    rows = M._stored(spark.createDataFrame([(1, "text " * 500)], "doc_id long, text string"), M.np.zeros(M.MAP_BITS >> 6, M.np.uint64))
    from pyspark.sql import functions as F

    bad = rows.where("uid IS NOT NULL").withColumn("media_sha256", F.lit("0" * 64)).withColumn("fetched", F.lit(None).cast("array<struct<pos:int,chunk:binary>>"))
    with pytest.raises(Exception, match="don't give its media"):
        M._rebuilt(bad).collect()


def test_map_may_be_full(spark):
    full = M.np.full(M.MAP_BITS >> 6, 0xFFFFFFFFFFFFFFFF, M.np.uint64)
    rows = M._stored(spark.createDataFrame([(1, "text " * 5000)], "doc_id long, text string"), full).collect()
    doc = next(r for r in rows if r.uid is not None)
    assert len(doc.shared) == len(doc.sizes) and len([r for r in rows if r.digest]) == len({c.digest for c in doc.shared})


def test_empty(spark):
    assert M.media_columns(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_of_other_names(spark):
    plain = spark.createDataFrame([(i, "text " * (i % 3 * 400)) for i in range(12)], "doc_id long, text string")
    odd = plain.selectExpr("*", *[f"1 AS {c}" for c in ("uid", "digest", "chunk", "pos", "shared", "fetched", "own", "sizes", "feature")])
    assert sorted(map(tuple, M.media_columns(odd).collect())) == sorted(map(tuple, M.media_columns(plain).collect()))
