"""SentencePiece BPE encoding and decoding in vectorised merge rounds."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

SPACE = "▁"
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct words whose ids a task keeps; beyond it the memory is emptied, which changes no result.
CACHE_WORDS = 150_000
#: Texts of one Arrow batch are encoded in groups of about so many characters.
GROUP_CHARS = 1_000_000


class _PairTable:
    """Finds the index of each of many keys, or -1, by probing a table of hashed slots."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.keys = np.append(keys, -2)
        home, todo, step = self._home(keys), np.arange(len(keys)), 0
        while len(todo):  # whoever finds its slot free takes it; the others try the next
            at = (home[todo] + step) & ((1 << self.bits) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo = todo[self.slots[at] != todo]
            step += 1
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        home = self._home(keys)
        out = self.slots[home]
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        for step in range(1, self.steps):
            if not len(todo):
                break
            got = self.slots[(home[todo] + step) & ((1 << self.bits) - 1)]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[got] != keys[todo])]
        out[todo] = -1
        return out


class _Index(dict):
    """Number of each word; a new one gets the next."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class BpeModel:
    """Pieces, merge table and byte pieces of a BPE model with byte fallback.

    Only the piece list is read from the model file. Symbols are piece ids; characters that are no piece
    but could start a merge do not exist in such a model, so any other character has the symbol -1 and
    ends as its UTF-8 bytes' pieces.
    """

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        is_byte = [sp.is_byte(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(pieces) if not special[i] and not is_byte[i]}
        self.byte_ids = np.zeros(256, np.int64)
        for i in range(n):
            if is_byte[i]:
                self.byte_ids[int(pieces[i][1:-1], 16)] = i
        self.chars = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece goes on after a word's end; such models are not supported")
        # Rank 0 is merged first; pieces of equal score share a rank.
        ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        rank = {i: ranks[sp.get_score(i)] for i in normal.values()}
        pairs: dict[int, tuple[int, int]] = {}
        joins: set[int] = set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = normal.get(p[:k]), normal.get(p[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = (rank[i], i)
            joins.update(self._join(a, b) for a, b in zip(p, p[1:], strict=False))
        keys = sorted(pairs)
        self.n = n
        self.table = _PairTable(np.array(keys, np.int64))
        self.pair_keys = np.array([*keys, 2**62], np.int64)
        self.pair_rank = np.array([*(pairs[k][0] for k in keys), 0], np.int64)
        self.pair_piece = np.array([*(pairs[k][1] for k in keys), 0], np.int64)
        # All occurrences of a pair may be merged at once if no pair that the new piece forms goes before it.
        own = np.zeros(n + 1, np.int64)
        for i, r in rank.items():
            own[i] = r
        left, right = self.pair_keys[:-1] // n, self.pair_keys[:-1] % n
        at_once = np.ones(n + 1, bool)
        at_once[left[self.pair_rank[:-1] <= own[left]]] = False
        at_once[right[self.pair_rank[:-1] <= own[right]]] = False
        self.at_once = at_once
        # A word may be cut between two characters that no piece holds side by side.
        self.joins = _PairTable(np.array(sorted(joins), np.int64))
        # Bytes that each id stands for when decoding.
        spelled = [b"" if special[i] and i != self.unk else b" \xe2\x81\x87 " if i == self.unk else bytes([int(pieces[i][1:-1], 16)]) if is_byte[i] else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.cumsum([0, *map(len, spelled)])
        self.is_byte = np.array(is_byte)
        self.silent = np.array([special[i] and i != self.unk for i in range(n)])
        self.spaced = np.array([s.startswith(b" ") and i != self.unk for i, s in enumerate(spelled)])

    @staticmethod
    def _join(a: str, b: str) -> int:
        return ord(a) << 21 | ord(b)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and the offsets of each word's ids."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        if not len(points):
            return np.empty(0, np.int64), np.zeros(len(words) + 1, np.int64)
        symbols = self.chars[points].astype(np.int64)

        # Segments: words, cut further where no piece spans two characters.
        first = np.ones(len(points), bool)
        first[1:] = word[1:] != word[:-1]
        first[1:] |= self.joins.find(points[:-1] << 21 | points[1:]) < 0
        segment = np.cumsum(first) - 1
        place = np.arange(len(points))

        done = self._merge(symbols, segment, place)
        return self._with_bytes(*done, points, word, len(words))

    def _merge(self, symbols: np.ndarray, segment: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds until no pair remains; returns symbols and their places, in order."""
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        total = len(symbols)
        while len(symbols):
            key = symbols[:-1] * self.n + symbols[1:]
            key[(segment[:-1] != segment[1:]) | (symbols[:-1] < 0) | (symbols[1:] < 0)] = -1
            at = self.table.find(key)
            pairs = np.flatnonzero(at >= 0)
            # Segments without any pair are finished and leave.
            busy = np.zeros(segment[-1] + 1, bool)
            busy[segment[pairs]] = True
            stay = busy[segment]
            ends.append((symbols[~stay], place[~stay]))
            if not len(pairs):
                break
            ranks, pieces = self.pair_rank[at[pairs]], self.pair_piece[at[pairs]]
            of = segment[pairs]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            least = np.minimum.reduceat(ranks, starts)
            group = np.cumsum(np.r_[False, of[1:] != of[:-1]])
            best = np.flatnonzero(ranks == least[group])
            # Of a segment's best pairs: all that do not overlap from the left, or the leftmost alone.
            b_at, b_group, b_piece = pairs[best], group[best], pieces[best]
            lead = np.r_[True, b_group[1:] != b_group[:-1]]
            chained = np.r_[False, (b_at[1:] == b_at[:-1] + 1) & ~lead[1:]]
            run = np.arange(len(best)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(best))))
            same = b_piece == b_piece[np.maximum.accumulate(np.where(lead, np.arange(len(best)), 0))]
            # A rank that several pieces share, or one whose piece may merge earlier, goes one at a time.
            free = np.logical_and.reduceat(same & self.at_once[b_piece], np.flatnonzero(lead))[np.cumsum(lead) - 1]
            take = lead | (free & (run % 2 == 0))
            symbols = symbols.copy()
            symbols[b_at[take]] = b_piece[take]
            stay[b_at[take] + 1] = False
            symbols, segment, place = symbols[stay], segment[stay], place[stay]
            segment = np.cumsum(np.r_[False, segment[1:] != segment[:-1]])
        all_symbols = np.full(total, -2, np.int64)
        for s, p in ends:
            all_symbols[p] = s
        place = np.flatnonzero(all_symbols > -2)
        return all_symbols[place], place

    def _with_bytes(self, symbols: np.ndarray, place: np.ndarray, points: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Put the byte pieces in for characters without a piece."""
        owner = word[place]
        lost = np.flatnonzero(symbols < 0)
        if len(lost):
            raw = [chr(p).encode("utf-8", "surrogatepass") for p in points[place[lost]]]
            sizes = np.ones(len(symbols), np.int64)
            sizes[lost] = [len(r) for r in raw]
            keep = np.repeat(symbols, sizes)
            keep[keep < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            symbols, owner = keep, np.repeat(owner, sizes)
        return symbols, np.searchsorted(owner, np.arange(n + 1))

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each document's ids. offsets: where each one's ids begin, and the end."""
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        speaks = ~self.silent[ids]
        ids, docs = ids[speaks], docs[speaks]
        # The blank that encoding put first goes again.
        strip = self.spaced[ids] & np.r_[True, docs[1:] != docs[:-1]][: len(ids)]
        sizes = self.spelled_at[ids + 1] - self.spelled_at[ids]
        begin, sizes = self.spelled_at[ids] + strip, sizes - strip
        total = np.cumsum(np.r_[0, sizes])
        flat = self.spelled[np.repeat(begin - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        cut = np.r_[0, total[np.searchsorted(docs, np.arange(len(offsets) - 1), "right")]]
        raw = self.is_byte[ids]
        odd = np.unique(docs[raw]) if raw.any() else ()
        out = [flat[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:], strict=False)]
        for d in odd:  # bytes that are no UTF-8 become one replacement each
            chunk = flat[cut[d] : cut[d + 1]]
            try:
                out[d] = chunk.decode("utf-8")
            except UnicodeDecodeError:
                out[d] = _lenient(chunk)
        return out


def _lenient(raw: bytes) -> str:
    parts = []
    while raw:
        try:
            parts.append(raw.decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            parts.append(raw[: e.start].decode("utf-8") + "�")
            raw = raw[e.start + 1 :]
    return "".join(parts)


@functools.lru_cache(maxsize=2)
def model(path: str) -> BpeModel:
    return BpeModel(path)


class Encoder:
    """Encodes texts through the distinct words of many texts at once."""

    def __init__(self, bpe: BpeModel, add_eos: bool = True):
        self.bpe, self.add_eos = bpe, add_eos
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.ids, self.offsets = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each."""
        if len(self.index) > CACHE_WORDS:
            self.reset()
        number, flat, sizes = self.index.__getitem__, [], []
        for text in texts:
            # Every word begins with the blank's symbol, which its key leaves out.
            words = text.split(" ") if text else ()
            if text and (SPACE in text or "" in words):
                words = [w[1:] for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
            flat.append(np.fromiter(map(number, words), np.int32, len(words)))
            sizes.append(len(words))
        if self.index.fresh:
            ids, offsets = self.bpe.encode_words([SPACE + w for w in self.index.fresh])
            self.index.fresh.clear()
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        words = np.concatenate(flat) if flat else np.empty(0, np.int32)
        ends = np.cumsum(np.r_[0, sizes]).astype(np.int64)
        starts, counts = self.offsets[words], self.offsets[words + 1] - self.offsets[words]
        upto = np.cumsum(np.r_[0, counts])
        ids = self.ids[np.repeat(starts - upto[:-1], counts) + np.arange(upto[-1])]
        bounds = upto[ends]
        if self.add_eos:
            ids = np.insert(ids, bounds[1:], self.bpe.eos)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


class Then(NamedTuple):
    """What is made of each batch of results, and the schema of that."""

    step: Callable[[pa.RecordBatch], pa.RecordBatch]
    schema: str


@functools.lru_cache(maxsize=2)
def encoder(path: str, add_eos: bool) -> Encoder:
    """A Python worker keeps its encoder, with the words met, from task to task."""
    return Encoder(model(path), add_eos)


def encode(docs: DataFrame, model_path: str, *, text: str = "text", out: str = "ids", keep: list[str] | None = None, add_eos: bool = True, back: str | None = None, then: "Then | None" = None) -> DataFrame:
    """Add the ids of text, as array<int>, exactly as the sentencepiece library gives them.

    A text is parted into words at blanks; the distinct words of many texts are merged together. Decided cases: null
    is encoded like the empty text; any character without a piece becomes its bytes' pieces; rows that repeat are encoded alike; an
    empty table gives no rows; keep names the columns to carry (all by default), a column named as out is replaced. back names a column for the
    text that decode() makes of the ids, in the same pass. then turns each batch of results to another one before it leaves
    its task, for uses that need no ids outside.
    """
    carried = [c for c in (docs.columns if keep is None else keep) if c not in (out, back)]
    schema = docs.select(*carried).withColumn(out, F.array(F.lit(0)))
    schema = (schema.withColumn(back, F.lit("")) if back else schema).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model_path, add_eos)
        for batch in batches:
            for part in _groups(batch, text):
                ids, bounds = coder.encode(part.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                texts = [pa.array(coder.bpe.decode(ids, bounds), pa.string())] if back else []
                found = pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), lists, *texts], names)
                yield then.step(found) if then else found

    return docs.select(*dict.fromkeys([*carried, text])).mapInArrow(run, then.schema if then else schema)


def decode(docs: DataFrame, model_path: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that ids stand for. Control ids are silent; null ids give the empty text."""
    carried = [c for c in docs.columns if c != out]
    schema = docs.select(*carried).withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(model_path)
        for batch in batches:
            lists = batch.column(ids)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(np.r_[0, sizes]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(texts, pa.string())], [*carried, out])

    return docs.mapInArrow(run, schema)


def _groups(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about GROUP_CHARS bytes of text; a longer text stands alone."""
    sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > GROUP_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    """doc_id, number of ids, and digests of the ids' decimals and of the decoded text, of a batch with ids and decoded."""
    lists = batch.column("ids")
    spelled = np.array([str(i) for i in range(int(lists.values.to_numpy().max(initial=0)) + 1)], object)
    flat, ends = spelled[lists.values.to_numpy()].tolist(), lists.offsets.to_numpy()
    ids = [hashlib.sha256(" ".join(flat[a:b]).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
    texts = [hashlib.sha256(t.as_buffer().to_pybytes()).hexdigest() for t in batch.column("decoded")]
    columns = [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(ids), pa.array(texts)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op2_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    then = Then(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return encode(docs, model_path or default_model(), keep=["doc_id"], back="decoded", then=then)
