"""LM scoring with n-gram tries of Elias-Fano coded levels, one trie per shard of the n-grams.

A word trigram model in reversed order: a trie's first level are words, the second the words before them, the third the words before those.
Each level holds quantised log10 values, so a text and its counts cross the network once:

    p(w | v, u) = (c(v, u, w) + k(u) * (c(u, w) + MU * p(w))) / (c(v, u) + k(u) * (c(u) + MU)),    p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1))

which sums to 1 over all w. k(u) is PRIOR / (c(u) + MU) for frequent words (a share of SHARE or more of all tokens, so 1 / SHARE at most, which
every task knows with their counts), where the prior's weight is PRIOR, and one constant for all others. What is above the line is known in the
shard of w, and what is below it in the shard of u, where v is the word before; so a document's terms are added up wherever they are known.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, saved
from .words import WordHashes, hashes_of, slices

#: Weight of the unigrams in the bigrams' prior, of that in the trigrams', and the count that stands for that of words that are not frequent.
MU, PRIOR, RARE = 20.0, 5.0, 8
#: Share of a frequent word, and the count that it has at least; step and origin of the quantised log10 values.
SHARE, FREQUENT, STEP, ORIGIN = 1e-5, 64, 1 / 2048, -20.0
#: Tokens of a shard and of a batch of documents at least. Both grow with the root of all tokens, so that the pairs of a batch and a shard grow with the tokens.
UNIT_TOKENS, ROOT, LEAST_SHARDS, BATCH_DOCS = 1 << 20, 8, 24, 30_000
_START, _END = np.uint64(0), np.uint64(1)
#: Bits kept of the word before and of the one before that, under their word's and pair's own range.
_BEFORE, _SECOND = 40, 32
_LOW40, _LOW32 = np.uint64((1 << _BEFORE) - 1), np.uint64((1 << _SECOND) - 1)


class EliasFano:
    """A monotone sequence: low bits packed; high bits in unary, with a sampled count of zeros every 512 bits.

    Levels are written to a file and memory-mapped. A probe reads a block of 64 bytes of the high bits for each end of the values with its high
    part, and a few low parts between them; nothing else is unpacked.
    """

    BLOCK = 512

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = int(ones[-1]) + 2 if n else 1  # a zero ends the last part
        unary = np.zeros(-(-size // cls.BLOCK) * cls.BLOCK, np.uint8)
        unary[ones] = 1
        zeros = np.cumsum(np.r_[0, cls.BLOCK - unary.reshape(-1, cls.BLOCK).sum(1, dtype=np.int64)]).astype(np.uint64)
        low = np.empty((n, bits), np.uint8)
        for k in range(bits):
            low[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        # Nine bytes more, so that every low part may be read as a whole.
        return cls(n, bits, np.r_[np.packbits(low.ravel(), bitorder="little"), np.zeros(9, np.uint8)], np.packbits(unary, bitorder="little"), zeros)

    def write(self, f) -> tuple[int, ...]:
        f.write(bytes(-f.tell() % 8))
        at = f.tell()
        f.write(self.zeros.tobytes() + self.high.tobytes() + self.low.tobytes())
        return self.n, self.low_bits, at, len(self.zeros), len(self.high), len(self.low)

    @classmethod
    def mapped(cls, path: str, place: tuple[int, ...]) -> "EliasFano":
        n, bits, at, zeros, high, low = place
        flat = np.memmap(path, np.uint8, "r")
        ends = np.cumsum([at, 8 * zeros, high, low])
        return cls(n, bits, flat[ends[2] : ends[3]], flat[ends[1] : ends[2]], flat[ends[0] : ends[1]].view(np.uint64))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        """The low parts of the values at i."""
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        raw = self.low[(bit >> 3)[:, None] + np.arange(9)]
        first = np.ascontiguousarray(raw[:, :8]).view(np.uint64)[:, 0]
        shift = (bit & 7).astype(np.uint64)
        # Two shifts, as one by 64 is none.
        out = first >> shift | (raw[:, 8].astype(np.uint64) << np.uint64(1)) << (np.uint64(63) - shift)
        return out & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """The place of the kth zero (from 0) in the high bits."""
        block = np.searchsorted(self.zeros, k.astype(np.uint64), "right") - 1
        left = k - self.zeros[block].astype(np.int64)
        size = self.BLOCK // 8
        words = ~np.ascontiguousarray(self.high[block[:, None] * size + np.arange(size)]).view(np.uint64)
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        word = (upto <= left[:, None]).sum(1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, upto[row, np.maximum(word - 1, 0)], 0)
        bits = np.unpackbits(np.ascontiguousarray(words[row, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * self.BLOCK + word * 64 + (np.cumsum(bits, 1, dtype=np.int64) <= left[:, None]).sum(1)

    def find(self, x: np.ndarray, piece: int = 1 << 15) -> np.ndarray:
        """The place of each x in the sequence, or -1: its successor in the part that shares its high bits, if it is x itself."""
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        last = (int(self.zeros[-1]) - 1, np.uint64(1 << self.low_bits) - np.uint64(1) if self.low_bits < 64 else ~np.uint64(0))
        for at in range(0, len(x), piece):
            part = x[at : at + piece]
            high = np.minimum(part >> np.uint64(self.low_bits), np.uint64(last[0])).astype(np.int64)
            # Values with this high part lie between the zero before it and its own.
            start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - np.maximum(high - 1, 0), 0)
            stop = np.minimum(self._zero(high) - high, self.n)
            wanted, end = part & last[1], stop.copy()
            open_ = np.flatnonzero(start < stop)
            while len(open_):
                mid = (start[open_] + stop[open_]) >> 1
                below = self._lows(mid) < wanted[open_]
                start[open_] = np.where(below, mid + 1, start[open_])
                stop[open_] = np.where(below, stop[open_], mid)
                open_ = open_[start[open_] < stop[open_]]
            there = np.flatnonzero(start < end)
            there = there[self._lows(start[there]) == wanted[there]]
            there = there[(part[there] >> np.uint64(self.low_bits)).astype(np.int64) == high[there]]
            out[at + there] = start[there]
        return out


class Trie:
    """Three levels. A key of a level below the first is its parent's place there, then the bits kept of the word before; so a successor is sought in
    the context's own range. A level's values are numbers of STEP from ORIGIN on."""

    def __init__(self, path: str, places: dict[str, tuple[int, ...]]):
        self.levels = [EliasFano.mapped(path, places[f"keys{i}"]) for i in range(3)]
        self.path, self.places = path, places

    @staticmethod
    def write(path: str, keys: list[np.ndarray], values: list[dict[str, np.ndarray]]) -> dict[str, tuple[int, ...]]:
        """keys: of each level, ascending; values: arrays of each level by name."""
        places: dict[str, tuple[int, ...]] = {}
        with open(path, "wb") as f:
            for i, (key, named) in enumerate(zip(keys, values, strict=True)):
                places[f"keys{i}"] = EliasFano.of(key).write(f)
                for name, x in named.items():
                    places[f"{name}{i}"] = (f.tell(), len(x))
                    f.write(np.clip(np.rint((x - ORIGIN) / STEP), 0, 65535).astype(np.uint16).tobytes())
        return places

    def find(self, level: int, keys: np.ndarray) -> np.ndarray:
        return self.levels[level].find(keys)

    def value(self, name: str, level: int, place: np.ndarray, default: np.ndarray) -> np.ndarray:
        """Values at the places found, and default where there is none."""
        at, n = self.places[f"{name}{level}"]
        if not n:
            return default
        held = np.memmap(self.path, np.uint16, "r", at, (n,))
        return np.where(place >= 0, held[np.maximum(place, 0)] * STEP + ORIGIN, default)


def tokens_of(texts: pa.Array, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Flat word hashes of texts, each followed by the end, and the number of tokens of each."""
    flat, sizes = hashes_of(texts, known)
    return np.insert(flat, np.cumsum(sizes), _END), sizes + 1


def _folded(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == held_out).alias("held_out"), "text")


def _parts(batches: Iterator[pa.RecordBatch], most_tokens: int) -> Iterator[pa.RecordBatch]:
    """Batches of about most_tokens tokens, and of BATCH_DOCS documents at most."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def cut() -> Iterator[pa.RecordBatch]:
        for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield from slices(batch, "text", 6 * most_tokens, BATCH_DOCS)

    for batch in batches:
        more = batch.column("text").nbytes
        if held and (rows + batch.num_rows > BATCH_DOCS or size + more > 6 * most_tokens):
            yield from cut()
            held, rows, size = [], 0, 0
        held.append(batch)
        rows, size = rows + batch.num_rows, size + more
    if held:
        yield from cut()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n): counts of the training tokens by hash. Each task adds its own up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in _parts(batches, UNIT_TOKENS):
            flat, sizes = tokens_of(part.column("text"), known)
            learn = ~part.column("held_out").to_numpy(zero_copy_only=False)
            words, n = np.unique(flat[np.repeat(learn, sizes)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    return texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _shard(words: np.ndarray, before: np.ndarray, frequent: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each n-gram: by its word, and for frequent words by its pair."""
    key = words.copy()
    often = np.isin(words, frequent)
    key[often] ^= (before[often] & _LOW40) * np.uint64(0x9E3779B97F4A7C15)
    key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((key >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _sent(texts: DataFrame, frequent, shards: int, most_tokens: int) -> DataFrame:
    """Rows (shard, batch, docs, body): the trigrams of a batch of documents that belong to a shard; and one of the batch's documents, under a shard below 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHashes(), TaskContext.get().partitionId() << 32
        for part in _parts(batches, most_tokens):
            flat, sizes = tokens_of(part.column("text"), known)
            learn = part.column("held_out").to_numpy(zero_copy_only=False) ^ True
            firsts = np.cumsum(np.r_[0, sizes[:-1]])
            before = np.r_[_START, flat[:-1]]
            before[firsts] = _START
            second = np.r_[_START, before[:-1]]
            second[firsts] = _START
            doc = (np.repeat(np.arange(len(sizes)), sizes) << 1 | np.repeat(learn, sizes)).astype(np.uint16)
            shard = _shard(flat, before, frequent.value[0], shards)
            order = np.argsort(_together(flat, before, second, shard, shards), kind="stable")
            ranked = shard[order]
            cut = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            own = ranked[cut]
            bodies = [_pack(flat[o], before[o], second[o], doc[o]) for o in np.split(order, cut[1:])]
            ids = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            nulls = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            about = ids.tobytes() + nulls.astype(np.uint8).tobytes() + (~learn).astype(np.uint8).tobytes() + sizes.tobytes()
            n = len(bodies) + 1
            arrays = [pa.array([*own, -1 - number % 997], pa.int64()), pa.array([number] * n, pa.int64()), pa.array([len(sizes)] * n, pa.int32()), pa.array([*bodies, about], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "batch", "docs", "body"])
            number += 1

    return texts.mapInArrow(run, "shard long, batch long, docs int, body binary")


def _small(n: np.ndarray) -> bytes:
    """Counts as a byte each, and those from 255 on once more in whole."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int32).tobytes()


def _counts(held: bytes, n: int, at: int) -> tuple[np.ndarray, int]:
    """n counts that _small wrote at a place, and the place after them."""
    out = np.frombuffer(held, np.uint8, n, at).astype(np.int64)
    more = np.flatnonzero(out == 255)
    out[more] = np.frombuffer(held, np.int32, len(more), at + n)
    return out, at + n + 4 * len(more)


def _together(w: np.ndarray, b: np.ndarray, bb: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """One number each, by whose order shards are apart and, but for rare meetings of leading bits, equal words, pairs and trigrams together."""
    bits = shards.bit_length()
    pair = (b & _LOW40) >> np.uint64(23) << np.uint64(10) | (bb & _LOW32) >> np.uint64(22)
    left = 40 - bits
    return shard.astype(np.uint64) << np.uint64(64 - bits) | w >> np.uint64(40) << np.uint64(left) | pair >> np.uint64(max(27 - left, 0))


def _bits(x: np.ndarray) -> bytes:
    """Numbers as their lowest byte each, then planes of the further bits that the largest has, after the number of those planes."""
    more = max(int(x.max()).bit_length() - 8, 0) if len(x) else 0
    return bytes([more]) + x.astype(np.uint8).tobytes() + b"".join(np.packbits((x >> (8 + k)) & 1).tobytes() for k in range(more))


def _of_bits(held: bytes, n: int, at: int) -> np.ndarray:
    out = np.frombuffer(held, np.uint8, n, at + 1).astype(np.int64)
    size = -(-n // 8)
    for k in range(held[at]):
        out |= np.unpackbits(np.frombuffer(held, np.uint8, size, at + 1 + n + k * size), count=n).astype(np.int64) << (8 + k)
    return out


def _places(x: np.ndarray, n: int) -> bytes:
    """Ascending numbers below n, as a list or as a map of n bits, whichever is smaller."""
    if 16 * len(x) <= n:
        return x.astype(np.uint16).tobytes()
    there = np.zeros(n, np.uint8)
    there[x] = 1
    return np.packbits(there).tobytes()


def _of_places(held: bytes, k: int, n: int, at: int) -> tuple[np.ndarray, int]:
    """The k numbers that _places wrote at a place, and the place after them."""
    if 16 * k <= n:
        return np.frombuffer(held, np.uint16, k, at), at + 2 * k
    size = -(-n // 8)
    return np.flatnonzero(np.unpackbits(np.frombuffer(held, np.uint8, size, at), count=n)), at + size


def _pack(w: np.ndarray, b: np.ndarray, bb: np.ndarray, doc: np.ndarray) -> bytes:
    """Trigrams (word, 40 bits of the word before, 32 of the one before it) in an order that brings equal ones together, as a trie: each run of a word, of a
    pair and of a trigram once, with the number of those under it; and document and fold of each occurrence. In columns. Any order returns whole."""
    b, bb = b & _LOW40, bb & _LOW32
    new_w = np.r_[True, w[1:] != w[:-1]]
    new_b = new_w | np.r_[True, b[1:] != b[:-1]]
    new_bb = new_b | np.r_[True, bb[1:] != bb[:-1]]
    at_w, at_b, at_bb = map(np.flatnonzero, (new_w, new_b, new_bb))
    ends = [np.append(np.searchsorted(of, up), len(of)) for up, of in ((at_w, at_b), (at_b, at_bb))]
    sizes = [np.diff(e) for e in ends] + [np.diff(np.append(at_bb, len(w)))]
    before = b[at_b]
    # Words ascend, so the plane of their highest bytes has runs.
    planes = np.ascontiguousarray(w[at_w]).view(np.uint8).reshape(-1, 8).T
    parts = (planes, (before >> np.uint64(8)).astype(np.uint32), (before & np.uint64(255)).astype(np.uint8), bb[at_bb].astype(np.uint32))
    head = np.array([len(at_w), len(at_b), len(at_bb), len(w)], np.int32)
    return head.tobytes() + b"".join(x.tobytes() for x in parts) + b"".join(map(_small, sizes)) + _bits(doc)


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    """Words, bits of pairs and of trigrams; the word of each pair, the pair of each trigram, the trigram of each occurrence; its document and fold."""
    n_words, n_pairs, n_trios, n = (int(x) for x in np.frombuffer(body, np.int32, 4))
    at, out, sizes = 16, [], []
    for kind, size in ((np.uint8, 8 * n_words), (np.uint32, n_pairs), (np.uint8, n_pairs), (np.uint32, n_trios)):
        out.append(np.frombuffer(body, kind, size, at))
        at += size * np.dtype(kind).itemsize
    for size in (n_words, n_pairs, n_trios):
        told, at = _counts(body, size, at)
        sizes.append(told)
    planes, high, low, second = out
    words, doc = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel(), _of_bits(body, n, at)
    above = [np.repeat(np.arange(len(n)), n) for n in sizes]
    return words, high.astype(np.uint64) << np.uint64(8) | low, second.astype(np.uint64), *above, doc >> 1, doc & 1


def score_texts(docs: DataFrame, *, folds: int = 5, held_out: int = 1) -> DataFrame:
    """Log10 probability of every whole text under a smoothed trigram model, and under the unigram base.

    The model learns from documents whose crc32(doc_id as text) modulo folds is not held_out. Shards grow in number with the tokens;
    a task holds one shard at a time, builds its trie and looks its n-grams up in it; the trie's file is the task's own and goes with it.

    Returns doc_id, held_out, n_tokens (words and the end), n_known, train_tokens, base_score, score. Decided cases: null and empty texts
    have the end as their only token; rows that repeat are learnt from and scored each; a null doc_id is learnt from; with no
    training text N and V are 0 and only the prior scores; other columns are ignored; an empty table gives no rows. Of the words before, 40
    and 32 bits tell n-grams of one word and of one pair apart: a word with 10^8 contexts takes one in 10^4 unseen ones for seen.
    """
    texts = _folded(docs, folds, held_out)
    counts = saved(word_counts(texts), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where("word = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one a text
    often = counts.where((F.col("n") >= max(FREQUENT, SHARE * total)) & (F.col("word") != 0)).collect()  # 1 / SHARE rows at most
    found = np.array([(r["word"] & 0xFFFFFFFFFFFFFFFF, r["n"]) for r in often] + [(0, ends)], np.uint64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    by_low = np.argsort(found[:, 0] & _LOW40, kind="stable")
    # Frequent words and the start with their counts, by hash and by the bits kept of it.
    frequent = docs.sparkSession.sparkContext.broadcast((found[:, 0], found[:, 1].astype(np.int64), found[by_low, 0] & _LOW40, found[by_low, 1].astype(np.float64)))
    unit = max(UNIT_TOKENS, ROOT * int(total**0.5))
    shards = LEAST_SHARDS + total // unit
    scale = np.log10(total + 0.5 * (distinct + 1))

    def strength(before: np.ndarray) -> np.ndarray:
        """k(u) by the bits kept of u."""
        low, n = frequent.value[2:]
        at = np.minimum(np.searchsorted(low, before), len(low) - 1)
        return np.where(low[at] == before, PRIOR / (n[at] + MU), PRIOR / (RARE + MU))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        if frame["shard"].iat[0] < 0:
            return frame[["batch", "docs"]].assign(about=frame["body"], sums=None)
        parts = [_unpack(b) for b in frame["body"]]
        starts = [np.cumsum([0, *(len(p[i]) for p in parts[:-1])]) for i in range(3)]
        w, b, bb = (np.concatenate([p[i] for p in parts]) for i in range(3))
        b_word, bb_pair, trio = (np.concatenate([p[3 + i] + at for p, at in zip(parts, starts[i], strict=True)]) for i in range(3))
        doc, learn = (np.concatenate([p[i] for p in parts]) for i in (6, 7))
        rows = np.repeat(np.arange(len(frame)), [len(p[6]) for p in parts])
        del parts
        # The distinct words, pairs and trigrams of the shard, and their counts in training texts.
        words, number = np.unique(w, return_inverse=True)
        number = number[b_word]
        pairs, p_number = np.unique((number.astype(np.uint64) << np.uint64(_BEFORE)) | b, return_inverse=True)
        p_number = p_number[bb_pair]
        trios, t_number = np.unique((p_number.astype(np.uint64) << np.uint64(_SECOND)) | bb, return_inverse=True)
        # From a body's own words, pairs and trigrams to each occurrence.
        number, p_number, t_number = number[bb_pair[trio]], p_number[trio], t_number[trio]
        c1, c2, c3 = (np.bincount(x, learn, len(of)).astype(np.int64) for x, of in ((number, words), (p_number, pairs), (t_number, trios)))
        at = np.minimum(np.searchsorted(frequent.value[0], words), len(frequent.value[0]) - 1)
        c1 = np.where(frequent.value[0][at] == words, frequent.value[1][at], c1)
        p_word, p_before = (pairs >> np.uint64(_BEFORE)).astype(np.int64), pairs & _LOW40
        t_pair = (trios >> np.uint64(_SECOND)).astype(np.int64)
        k_before, k_word = strength(p_before), strength(words & _LOW40)
        log_p = np.log10(c1 + 0.5) - scale
        below = k_word * (c1 + MU)
        prior = k_before * (c2 + MU * 10 ** log_p[p_word])
        has1, has2, has3 = c1 > 0, c2 > 0, c3 > 0
        rank1, rank2 = np.cumsum(has1) - 1, np.cumsum(has2) - 1
        keys = [words[has1], (rank1[p_word].astype(np.uint64) << np.uint64(_BEFORE) | p_before)[has2], (rank2[t_pair].astype(np.uint64) << np.uint64(_SECOND) | trios & _LOW32)[has3]]
        values = [
            {"above": log_p[has1], "below": np.log10(below)[has1]},
            {"above": np.log10(prior)[has2], "below": np.log10(c2 + below[p_word])[has2]},
            {"above": np.log10(c3 + prior[t_pair])[has3]},
        ]
        handle, path = tempfile.mkstemp(prefix="keyloom-trie-")
        os.close(handle)
        try:
            trie = Trie(path, Trie.write(path, keys, values))
            # Each distinct n-gram is asked for once, under its place in the level above.
            at1 = trie.find(0, words)
            p_of = trie.value("above", 0, at1, np.full(len(words), np.log10(0.5) - scale))
            w_below = trie.value("below", 0, at1, np.log10(k_word * MU))
            at2 = np.where(at1[p_word] >= 0, trie.find(1, np.maximum(at1[p_word], 0).astype(np.uint64) << np.uint64(_BEFORE) | p_before), -1)
            p_above = trie.value("above", 1, at2, np.log10(k_before * MU) + p_of[p_word])
            p_below = np.where(words[p_word] == _END, 0.0, trie.value("below", 1, at2, w_below[p_word]))
            at3 = np.where(at2[t_pair] >= 0, trie.find(2, np.maximum(at2[t_pair], 0).astype(np.uint64) << np.uint64(_SECOND) | trios & _LOW32), -1)
            t_above = trie.value("above", 2, at3, p_above[t_pair])
            del trie
        finally:
            os.unlink(path)
        offset = np.cumsum(np.r_[0, frame["docs"].to_numpy()])
        place = offset[rows] + doc
        here, slot = np.unique(place, return_inverse=True)
        base = np.bincount(slot, log_p[number])
        score = np.bincount(slot, t_above[t_number] - p_below[p_number])
        known = np.bincount(slot, has1[number]).astype(np.int64)
        cut = np.searchsorted(here, offset)
        told = [
            np.int32(j - i).tobytes() + base[i:j].tobytes() + score[i:j].astype(np.float32).tobytes() + _places(here[i:j] - o, n) + _small(known[i:j])
            for i, j, o, n in zip(cut, cut[1:], offset, frame["docs"], strict=False)
        ]
        return pd.DataFrame({"batch": frame["batch"], "docs": frame["docs"], "about": None, "sums": told})

    sums = _sent(texts, frequent, shards, unit).groupBy("shard").applyInPandas(run, "batch long, docs int, about binary, sums binary")
    first_below = np.log10(ends + PRIOR / (ends + MU) * (ends + MU))

    def total_up(frame: pd.DataFrame) -> pd.DataFrame:
        about = next(a for a in frame["about"] if a is not None)
        n = int(frame["docs"].iat[0])
        ids, nulls = np.frombuffer(about, np.int64, n), np.frombuffer(about, np.uint8, n, 8 * n).astype(bool)
        out, sizes = np.frombuffer(about, np.uint8, n, 9 * n).astype(bool), np.frombuffer(about, np.int64, n, 10 * n)
        base, score, known = np.zeros(n), np.full(n, -first_below), np.zeros(n, np.int64)
        for told in sorted(t for t in frame["sums"] if t is not None):  # in one order, whatever order they came in
            k = int(np.frombuffer(told, np.int32, 1)[0])
            at, end = _of_places(told, k, n, 4 + 12 * k)
            base[at] += np.frombuffer(told, np.float64, k, 4)
            score[at] += np.frombuffer(told, np.float32, k, 4 + 8 * k)
            known[at] += _counts(told, k, end)[0]
        doc_id = pd.array(ids, "Int64")
        doc_id[nulls] = pd.NA
        return pd.DataFrame({"doc_id": doc_id, "held_out": out, "n_tokens": sizes, "n_known": known, "base_score": base, "score": score})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return sums.groupBy("batch").applyInPandas(total_up, schema).withColumn("train_tokens", F.lit(int(total)).cast("long"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_texts(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
