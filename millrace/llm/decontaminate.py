"""Benchmark decontamination by a prefix-filtered join of word windows.

Every window of an item must occur whole, so the needed prefix of a window is
its rarest word, by its frequency over all documents. A document word that is
such a prefix proposes a window at a known offset; length and position bounds
drop it if it does not fit, and the words themselves decide. A document is read
as a stream, whatever its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.llm.words import texts_of

WINDOW = 10
BLOCK_CHARACTERS = 16_000_000
# Bytes that end a word once A-Z are lower-cased: all ASCII but digits and a-z.
_LOWER = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def benchmark_words(text: bytes | None) -> list[bytes]:
    """Words of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return (text or b"").translate(_LOWER).split()


def item_windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Windows of ``size`` words; fewer words are one window, none are none."""
    length = min(size, len(words))
    return [tuple(words[i : i + length]) for i in range(len(words) - length + 1)] if length else []


def _word_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """How often the words of ``vocabulary`` occur in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = vocabulary.value, Counter()
        for batch in batches:
            for text in texts_of(batch, 0):
                counts.update(filter(known.__contains__, benchmark_words(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def prefix_table(items: list[tuple[str | None, bytes | None]], frequency: dict[bytes, int], size: int) -> dict:
    """Rarest word to its (offset, length) to the windows it proposes to their items."""
    table: dict = {}
    for item, text in items:
        for window in set(item_windows(benchmark_words(text), size)):
            rarest = min(window, key=lambda word: (frequency.get(word, 0), word))
            places = table.setdefault(rarest, {})
            place = (window.index(rarest), len(window))
            places.setdefault(place, {}).setdefault(b" ".join(window), set()).add(item)
    return table


def occurrences(words: list[bytes], table: dict) -> tuple[list[tuple[int, int]], set]:
    """Word ranges of the windows that occur in ``words``, and their items."""
    ranges, items = [], set()
    for at, word in enumerate(words):
        if word in table:
            for (offset, length), windows in table[word].items():
                start = at - offset
                if start >= 0 and start + length <= len(words):
                    found = windows.get(b" ".join(words[start : start + length]))
                    if found:
                        ranges.append((start, start + length))
                        items |= found
    return ranges, items


STATE = "n_words long, n_hit long, hits binary, items array<string>"


def _scan(docs: DataFrame, text: str, table, first: bool) -> DataFrame:
    """Adds the hits of one block of items to the last four columns of ``docs`` (STATE, one bit a word in ``hits``)."""
    at = docs.columns.index(text)
    added = StructType.fromDDL(STATE).fields
    prefix = "_" * (1 + max(len(name) - len(name.lstrip("_")) for name in docs.columns))
    schema = StructType(docs.schema.fields + [StructField(prefix + f.name, f.dataType) for f in added]) if first else docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = table.value
        for batch in batches:
            columns = list(batch.columns) if first else list(batch.columns)[:-4]
            before = None if first else list(zip(*(batch.column(batch.num_columns - k).to_pylist() for k in (2, 1)), strict=True))
            counts, hits, masks, lists = [], [], [], []
            for row, value in enumerate(texts_of(batch, at)):
                words = benchmark_words(value)
                ranges, items = occurrences(words, prefixes)
                hit = np.zeros(len(words), bool)
                for start, end in ranges:
                    hit[start:end] = True
                if before:
                    hit |= np.unpackbits(np.frombuffer(before[row][0], np.uint8), count=len(words)).astype(bool)
                    items |= set(before[row][1])
                counts.append(len(words))
                hits.append(int(hit.sum()))
                masks.append(np.packbits(hit).tobytes())
                lists.append(sorted(i for i in items if i is not None))
            columns += [
                pa.array(counts, pa.int64()),
                pa.array(hits, pa.int64()),
                pa.array(masks, pa.binary()),
                pa.array(lists, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.mapInArrow(scan, schema)


def _with_hits(docs: DataFrame, benchmark: DataFrame, size: int, block: int) -> DataFrame:
    """``docs`` with the columns of STATE, under unused names, at the end."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    current = docs
    for number in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = [(row[0], row[1].encode()) for row in part.collect()]
        vocabulary = spark.sparkContext.broadcast({word for _, text in rows for word in benchmark_words(text)})
        frequency = {bytes(row[0]): row[1] for row in _word_counts(docs, vocabulary).collect()}
        table = spark.sparkContext.broadcast(prefix_table(rows, frequency, size))
        current = _scan(current, "text", table, first=number == 0)
    return current


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK_CHARACTERS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and items for every row of ``docs``.

    ``benchmark`` (item_id, text) is cut into blocks of about ``block``
    characters, and each table sent to the tasks holds one block; documents
    pass through the blocks in turn. Null and empty texts have no words and no
    hits; items without words propose nothing; repeated items are merged; an
    item without id marks words but is not listed. Repeated rows each give a
    row. Without items no document has hits; without documents the result is
    empty. No other columns are read.
    """
    found = _with_hits(docs.select("doc_id", "text"), benchmark, size, block)
    n_words, n_hit, _, items = (F.col(name) for name in found.columns[-4:])
    return found.select(
        "doc_id",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        items.alias("items"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK_CHARACTERS) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, with the columns they have."""
    found = _with_hits(docs, benchmark, size, block)
    return found.filter(F.col(found.columns[-3]) == 0).select(*docs.columns)
