"""Media columns: content-defined chunks, deduplicated by digest, from which verified media are put together."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved, spread_join

#: Chunk sizes in bytes: least, mean beyond the least (a power of two), most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 16384
#: Bits of the map of digests that occur more than once; it is the only thing sent to all tasks.
MAP_BITS = 1 << 25
LEVEL = 9
_RATE = 8000
# The gear values: one 32-bit number for each byte, by rule.
GEAR = np.array([zlib.crc32(b"gear" + bytes([b])) for b in range(256)], np.uint32)


def wav(samples: bytes) -> bytes:
    """8-bit mono PCM in a RIFF container; losslessly the samples themselves behind a 44-byte head."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, _RATE, _RATE, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> bytes:
    """The samples of a file that wav() made."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not an 8-bit PCM file")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes of text, and those with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def cuts(media: bytes) -> list[int]:
    """Ends of the chunks of media. The gear hash of a place covers the 32 bytes up to it."""
    n = len(media)
    if n <= MIN_CHUNK:
        return [n]
    h = GEAR[np.frombuffer(media, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # doubling the window adds it to itself, moved on
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    places = np.flatnonzero(h & np.uint32((MEAN_CHUNK - 1) << 20) == 0) + 1
    ends, start = [], 0
    while n - start > MIN_CHUNK:
        i = np.searchsorted(places, start + MIN_CHUNK)
        end = min(int(places[i]) if i < len(places) else n, start + MAX_CHUNK, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def chunks(media: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk in order."""
    ends = cuts(media)
    return [(hashlib.sha256(c).digest(), c) for c in (media[a:b] for a, b in zip([0, *ends], ends, strict=False))]


def bit_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big") % MAP_BITS


def features(samples: bytes) -> str:
    """Mean, deviation, share of sign changes around 128, and the largest sample."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64)
    high = x >= 128
    return f"mean={x.mean():.4f};std={x.std():.4f};zcr={np.mean(high[1:] != high[:-1]):.6f};peak={int(x.max())}"


def _digests(docs: DataFrame) -> DataFrame:
    """(bit, digest) of every chunk; a task names a digest at most twice, which is enough to tell repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in batch.column("text"):
                for digest, _ in chunks(wav(payload_of(text.as_py())[1])):
                    seen[digest] = seen.get(digest, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(seen.values(), pa.int64())], ["digest", "n"])

    return docs.select("text").mapInArrow(run, "digest binary, n long")


_STORE = "uid long, doc_id long, n_bytes long, media_sha256 string, sizes array<int>, shared array<struct<pos:int,digest:binary>>, own binary, digest binary, chunk binary"


def _stored(docs: DataFrame, repeated: np.ndarray) -> DataFrame:
    """One row per document, with the chunks that are its alone; one row per chunk that may be shared.

    The map may take a chunk for shared that is not, which moves it to the chunk rows and changes nothing else.
    """
    words = docs.sparkSession.sparkContext.broadcast(repeated)
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.string()), ("sizes", pa.list_(pa.int32())), ("shared", pa.list_(pa.struct([("pos", pa.int32()), ("digest", pa.binary())]))), ("own", pa.binary()), ("digest", pa.binary()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bits, pack = TaskContext.get().partitionId() << 40, words.value, zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows, lent = [], {}
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                n, payload = payload_of(text.as_py())
                media = wav(payload)
                sizes, shared, own, seen = [], [], [], set()
                for pos, (digest, chunk) in enumerate(chunks(media)):
                    sizes.append(len(chunk))
                    bit = bit_of(digest)
                    if bits[bit >> 6] >> (bit & 63) & 1 or digest in seen:
                        shared.append({"pos": pos, "digest": digest})
                        lent.setdefault(digest, chunk)
                    else:
                        own.append(chunk)
                    seen.add(digest)
                rows.append({"uid": at, "doc_id": doc_id.as_py(), "n_bytes": n, "media_sha256": hashlib.sha256(media).hexdigest(), "sizes": sizes, "shared": shared, "own": pack.compress(b"".join(own))})
                at += 1
            rows += [{"digest": d, "chunk": pack.compress(c)} for d, c in lent.items()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STORE)


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _rebuilt(rows: DataFrame) -> DataFrame:
    """Put each document's media together in chunk order, verify them and compute from what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = unpack.decompress(row["own"])
                got = {c["pos"]: unpack.decompress(c["chunk"]) for c in row["fetched"] or ()}
                parts, at = [], 0
                for pos, n in enumerate(row["sizes"]):
                    if pos in got:
                        parts.append(got[pos])
                    else:
                        parts.append(own[at : at + n])
                        at += n
                media = b"".join(parts)
                digest = hashlib.sha256(media).hexdigest()
                if digest != row["media_sha256"]:
                    raise ValueError(f"the chunks of document {row['doc_id']} don't give its media")
                payload = samples_of(media)
                out.append((row["doc_id"], row["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), digest, features(payload)))
            names = [f.split()[0] for f in _OUT.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in _OUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(len(names))], names)

    return rows.mapInArrow(run, _OUT)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as 8-bit media in deduplicated chunks, read them back and describe them.

    The chunk store has each document's own chunks beside its chunk list, and every chunk that occurs more than once under its
    digest, once. Which digests occur more than once goes to all tasks as a map of MAP_BITS bits. Documents whose chunks are all their
    own are read back by a scan; the others fetch the shared chunks by a join on the digest, which deals a hot digest over tasks.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Decided cases: null is
    stored like the empty text, as 64 zeros; rows that repeat and rows with a null doc_id are stored each; equal texts give equal
    values; other columns are ignored; an empty table gives no rows. A payload that doesn't match its digest fails the job.
    """
    many = _digests(docs).groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    bit = F.pmod(F.conv(F.hex(F.substring("digest", 5, 4)), 16, 10).cast("long"), F.lit(MAP_BITS))
    words = many.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    repeated = np.zeros(MAP_BITS >> 6, np.uint64)
    for row in words.collect():  # MAP_BITS / 64 rows at most
        repeated[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF

    store = saved(_stored(docs, repeated), "media-store")
    lent = saved(store.where("digest IS NOT NULL").groupBy("digest").agg(F.first("chunk").alias("chunk")), "media-chunks")
    rows = store.where("uid IS NOT NULL").drop("digest", "chunk")
    none = F.lit(None).cast("array<struct<pos:int,chunk:binary>>")
    alone = rows.where(F.size("shared") == 0).withColumn("fetched", none)
    asked = rows.where(F.size("shared") > 0)
    fetched = (
        spread_join(asked.select("uid", F.explode("shared").alias("c")).select("uid", "c.pos", "c.digest"), lent, ["digest"], ["uid"])
        .groupBy(F.col("uid").alias("of"))
        .agg(F.collect_list(F.struct("pos", "chunk")).alias("fetched"))
    )
    some = asked.join(fetched, F.col("uid") == F.col("of")).drop("of")
    return _rebuilt(alone).unionAll(_rebuilt(some))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
