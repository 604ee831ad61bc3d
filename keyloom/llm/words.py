"""Words of texts and their hashes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes that a task keeps; beyond it they are forgotten, which changes no result.
KEPT = 300_000
#: Hashes that stand for no word.
RESERVED = 16


class WordHashes(dict):
    """64-bit hash of each word met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = max(RESERVED, xxhash.xxh64_intdigest(word))
        return h


def words_of(texts: pa.Array) -> Iterator[list[bytes]]:
    """The words of each text in UTF-8, A-Z lower-cased; null has none.

    Splitting bytes parts at space and the five control blanks, and at nothing else, as the contracts ask.
    """
    for text in texts.cast(pa.binary()):
        raw = text.as_buffer()
        yield raw.to_pybytes().translate(_FOLD).split() if raw is not None else []


def hashes_of(texts: pa.Array, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Flat word hashes of all texts, and the number of words of each."""
    if len(known) > KEPT:
        known.clear()
    of, flat, sizes = known.__getitem__, [], []
    for words in words_of(texts):
        flat.append(np.fromiter(map(of, words), np.uint64, len(words)))
        sizes.append(len(words))
    return (np.concatenate(flat) if flat else np.empty(0, np.uint64)), np.array(sizes, np.int64)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about most_bytes of text; a longer text stands alone."""
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and (total + n > most_bytes or i - start >= most_rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if batch.num_rows > start:
        yield batch.slice(start)
