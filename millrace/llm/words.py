"""Words, window hashes and Arrow batches shared by the document operators.

Words are runs of bytes other than ASCII white space, read from UTF-8, so every
character beyond ASCII counts as part of a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

CACHED_WORDS = 100_000
ROWS_AT_ONCE = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class WordHashes(dict):
    """64-bit hash of a word, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` consecutive words, in order."""
    count = max(0, len(hashes) - size + 1)
    mixed = np.full(count, size, np.uint64)
    for i in range(size):
        mixed ^= hashes[i : i + count]
        mixed *= _MIX
        mixed ^= mixed >> _SHIFT
    return mixed


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct windows of ``size`` words; fewer words make one window, none make none."""
    return np.unique(window_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


_CONTINUATION = bytes(range(0x80, 0xC0))


def characters(text: bytes, without: bytes = b"") -> int:
    """Code points of a UTF-8 text, not counting those in ``without``."""
    return len(text.translate(None, _CONTINUATION + without))


def texts_of(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    """A text column as UTF-8 bytes, a few rows at a time, so that a batch is not held twice."""
    values = batch.column(column).cast(pa.binary())
    for start in range(0, len(values), ROWS_AT_ONCE):
        yield from values.slice(start, ROWS_AT_ONCE).to_pylist()


def ids_of(batch: pa.RecordBatch, column: int) -> list:
    return batch.column(column).to_pylist()


def fold_remainder(doc_id, folds: int) -> int:
    """Fold of an id: crc32 of its decimal text; a null id counts as empty text."""
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], list[list] | dict], schema: str) -> DataFrame:
    """``function`` turns each Arrow batch of ``df`` into columns of ``schema``."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = function(batch)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return df.mapInArrow(run, schema)
