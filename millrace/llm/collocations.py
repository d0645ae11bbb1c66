"""Phrase collocations by prefix-free parsing.

A text is cut wherever the hash of a window of ``OVERLAP`` words says so; a chunk
runs from one such window to the end of the next, so neighbours share the window
and equal passages give equal chunks wherever they stand. The distinct chunks and
their frequencies are the dictionary, and phrases are counted in it, each distinct
chunk once, by its frequency. A phrase belongs to the chunk in whose own part, all
of it but the window shared with the next, it begins; so each is counted once.

Only phrases of ``LEAST`` occurrences are wanted. A sieve of fixed size, sums of
counts by hash, tells which phrases cannot have that many; the others are counted
exactly, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.words import window_hashes
from millrace.session import cut_lineage

LEAST, LONGEST, FIRST_ROWS = 100, 5, 2000
OVERLAP = LONGEST - 1
EVERY = 32
NO_LANGUAGE = "und"
# What ends a piece, as a run with blanks; in the stream of words a break stands for it, which is no word itself.
BREAKS = r"[.,;:!?\n\x0B\f\r][ \t.,;:!?\n\x0B\f\r]*"
BREAK = "."
TEXT_BYTES = 4_000_000
# Counters of the sieve for each length, as a power of two: about one for each word of the dictionary, within bounds.
SIEVE_LEAST, SIEVE_MOST = 16, 23
SIEVE_BLOCK = 1 << 18
COPIES = 8
FANOUT = 64
SALTS = 16
_MIX, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_DRAWS = np.random.default_rng(13).integers(0, 1 << 64, 256, np.uint64)


def streams(texts: pa.Array) -> pa.ListArray:
    """The lower-cased words of each text, with a break between pieces; null for a text without any."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts), BREAKS, f" {BREAK} ")
    marked = pc.ascii_trim(marked, " \t")
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(marked, ""), pa.scalar(None, pa.string()), marked))


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column side by side, and where each value begins, with their end."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets - offsets[0]).astype(np.int64)


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each of some words, none empty: its bytes' draws weighted by powers of their places."""
    data, offsets = bytes_of(words)
    lengths = np.diff(offsets)
    powers = np.multiply.accumulate(np.full(int(lengths.max(initial=0)), _MIX))
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    sums = np.add.reduceat(_DRAWS[data] * powers[place], offsets[:-1]) if len(words) else np.zeros(0, np.uint64)
    return (sums ^ sums >> _SHIFT) * _MIX


def chunk_bounds(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and number of own places of each chunk of streams that lie side by side between ``bounds``."""
    windows = window_hashes(hashes, OVERLAP)
    cuts = np.flatnonzero(windows % np.uint64(EVERY) == 0)
    ends = bounds[np.searchsorted(bounds, cuts, "right")]
    starts = np.union1d(bounds[:-1][np.diff(bounds) > 0], cuts[cuts + OVERLAP <= ends])
    following = np.append(starts[1:], len(hashes))
    ends = bounds[np.searchsorted(bounds, starts, "right")]
    return starts, np.minimum(following + OVERLAP, ends), np.minimum(following, ends) - starts


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """``texts`` in runs of about ``TEXT_BYTES``, with the place of the first."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TEXT_BYTES, "right")))
        yield start, texts.slice(start, end - start)
        start = end


def dictionary(docs: DataFrame) -> DataFrame:
    """lang, own, chunk and n for the distinct chunks of ``docs`` (text, lang) of each language."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                lists = streams(texts)
                words = lists.flatten()
                if not len(words):
                    continue
                bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                starts, ends, own = chunk_bounds(hashes_of(words), bounds)
                rows = first + np.searchsorted(bounds, starts, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(own), joined(words, starts, ends - starts)], ["lang", "own", "chunk"]
                )

    rows = docs.select(lang.alias("lang"), "text").mapInArrow(parse, "lang string, own long, chunk string")
    return rows.groupBy("lang", "own", "chunk").agg(F.count(F.lit(1)).alias("n"))


class Places:
    """The words of many chunks side by side, and what may begin at each place."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        own, counts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
        chunks = pc.split_pattern(batch.column(2), " ")
        self.words = chunks.flatten()
        self.hashes = hashes_of(self.words)
        lengths = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        chunk_of = np.repeat(np.arange(len(lengths)), lengths)
        at = np.arange(len(self.words))
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[chunk_of]
        self.count = counts[chunk_of]
        self.owned = at - (ends - lengths)[chunk_of] < own[chunk_of]
        breaks = np.append(pc.indices_nonzero(pc.equal(self.words, BREAK)).to_numpy().astype(np.int64), len(at))
        following = breaks[np.searchsorted(breaks, at)]
        # Words from here to the next break or the end of the chunk.
        self.room = np.minimum(following, ends[chunk_of]) - at
        self.marks = np.array([xxh3_64_intdigest(name) for name in self.langs], np.uint64)[self.lang]
        self.numbers: np.ndarray | None = None

    def by_length(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length up to LONGEST: the places where as many words of one piece begin, and the hashes of all windows."""
        hashed = self.hashes ^ self.marks
        for size in range(1, LONGEST + 1):
            if size > 1:
                hashed = hashed[:-1] ^ self.hashes[size - 1 :]
            hashed = hashed * _MIX
            hashed ^= hashed >> _SHIFT
            yield size, np.flatnonzero(self.room >= size), hashed

    def sums(self, size: int, at: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place and the total count of each phrase of ``size`` words at the places ``at``.

        Places are grouped by hash and compared with the first of their group; one
        that differs stands alone.
        """
        if self.numbers is None:
            self.numbers = self.words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        _, first, group = np.unique(hashed[at], return_index=True, return_inverse=True)
        likened = at[first][group]
        same = self.lang[at] == self.lang[likened]
        for i in range(size):
            same &= self.numbers[at + i] == self.numbers[likened + i]
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, group[same], self.count[at[same]])
        return np.append(at[first], at[~same]), np.append(totals, self.count[at[~same]])


def joined(words: pa.Array, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The runs of ``words`` at ``starts``, each as one text."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(places))), " ")


def counter(hashed: np.ndarray, bits: int) -> np.ndarray:
    """The sieve's counter for a hash."""
    return (hashed >> np.uint64(64 - bits)).astype(np.int64)


def sieve_bits(words: int) -> int:
    return min(SIEVE_MOST, max(SIEVE_LEAST, int(words).bit_length()))


def _sieve(chunks: DataFrame, bits: int, least: int) -> np.ndarray:
    """For each length, which counters reach ``least``; sums stop there or at 255, so a counter is one byte."""
    width, least = min(SIEVE_BLOCK, 1 << bits), min(least, 255)
    names, schema = ["level", "block", "copy", "counts"], "level int, block int, copy int, counts binary"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((LONGEST, 1 << bits), np.uint32)
        added = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places = Places(batch)
            added += len(places.words)
            if added * least >= 1 << 31:
                np.minimum(held, least, out=held)
                added = len(places.words)
            clipped = np.minimum(places.count, least).astype(np.uint32)
            for size, at, hashed in places.by_length():
                at = at[places.owned[at]]
                np.add.at(held[size - 1], counter(hashed[at], bits), clipped[at])
        rows = np.minimum(held, least).astype(np.uint8).reshape(LONGEST, -1, width)
        copy = TaskContext.get().partitionId() % COPIES
        levels, blocks = np.nonzero(rows.any(axis=2))
        for start in range(0, len(levels), 64):
            some = list(zip(levels[start : start + 64].tolist(), blocks[start : start + 64].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([level for level, _ in some], pa.int32()),
                    pa.array([block for _, block in some], pa.int32()),
                    pa.array([copy] * len(some), pa.int32()),
                    pa.array([pa.compress(rows[place].tobytes(), "zstd", asbytes=True) for place in some], pa.binary()),
                ],
                names,
            )

    def added(table: pa.Table) -> np.ndarray:
        held = np.zeros(width, np.uint32)
        for value in table["counts"]:
            held += np.frombuffer(pa.decompress(value.as_py(), width, "zstd", asbytes=True), np.uint8)
            np.minimum(held, least, out=held)
        return held

    def row(key: tuple[pa.Scalar, ...], counts: bytes) -> pa.Table:
        return pa.table([*[pa.array([k.as_py()], pa.int32()) for k in key], pa.array([counts], pa.binary())], names)

    def partial(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return row(key, pa.compress(added(table).astype(np.uint8).tobytes(), "zstd", asbytes=True))

    def final(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return row((*key, pa.scalar(0)), np.packbits(added(table) >= least).tobytes())

    some = chunks.select("lang", "own", "chunk", "n").mapInArrow(sums, schema)
    some = some.groupBy("level", "block", "copy").applyInArrow(partial, schema)
    packed = np.zeros((LONGEST, (1 << bits) // width, width // 8), np.uint8)
    for found in some.groupBy("level", "block").applyInArrow(final, schema).collect():
        packed[found["level"], found["block"]] = np.frombuffer(found["counts"], np.uint8)
    return packed.reshape(LONGEST, -1)


def phrase_counts(chunks: DataFrame, bits: int, least: int = LEAST) -> DataFrame:
    """lang, phrase, size and f of all phrases of 1 to ``LONGEST`` words that occur ``least`` times, and of size 0 all words."""
    shared = chunks.sparkSession.sparkContext.broadcast(_sieve(chunks, bits, least))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = shared.value

        def passes(size: int, keys: np.ndarray) -> np.ndarray:
            return (reached[size - 1, keys >> 3] >> (7 - (keys & 7)).astype(np.uint8)) & 1 == 1

        def rows(langs: pa.Array, phrases: pa.Array, size: int, f: np.ndarray) -> pa.RecordBatch:
            columns = [langs, phrases, pa.array(np.full(len(f), size), pa.int32()), pa.array(f, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            places = Places(batch)
            langs = pa.array(places.langs, pa.string())
            before = np.ones(len(places.words) + 1, bool)
            for size, at, hashed in places.by_length():
                if size == 1:
                    own = at[places.owned[at]]
                    totals = np.zeros(len(langs), np.int64)
                    np.add.at(totals, places.lang[own], places.count[own])
                    yield rows(langs, pa.array([""] * len(langs)), 0, totals)
                # A phrase is as rare as its parts.
                at = at[before[at] & before[at + 1]] if size > 1 else at
                at = at[passes(size, counter(hashed[at], bits))]
                before = np.zeros(len(places.words) + 1, bool)
                before[at] = True
                starts, f = places.sums(size, at[places.owned[at]], hashed)
                phrases = joined(places.words, starts, np.full(len(starts), size))
                yield rows(langs.take(pa.array(places.lang[starts])), phrases, size, f)

    found = chunks.select("lang", "own", "chunk", "n").mapInArrow(count, "lang string, phrase string, size int, f long")
    totals = found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return totals.filter((F.col("f") >= least) | (F.col("size") == 0))


def _part_salt(size: Column, phrase: Column) -> Column:
    """Parts of one word stand in very many phrases: their rows are dealt over ``SALTS`` keys."""
    return F.when(size == 1, F.pmod(F.xxhash64(phrase), F.lit(SALTS)).cast("int")).otherwise(0)


def maximal(counts: DataFrame, least_share: int = 100) -> DataFrame:
    """The phrases of two words and more in ``counts``, but for those always inside a longer one.

    With a phrase as frequent as its part, all between them are too, so it is enough to look at one word more.
    """
    words = F.split("phrase", " ", -1)
    inner = F.array(
        F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " ")
    )
    longer = counts.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    joined = counts.filter("size > 1").join(longer, ["lang", "phrase"], "left")
    inside = 100 * F.coalesce("longer", F.lit(0)) >= least_share * F.col("f")
    return joined.filter(~inside).drop("longer")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of ``phrases``: of the cut of each that scores least, the first of equal ones."""
    words = F.split("phrase", " ", -1)
    cut = phrases.select("lang", "phrase", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.select(
        "*",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    cut = cut.withColumn("first_salt", _part_salt(F.col("k"), F.col("phrase")))
    cut = cut.withColumn("rest_salt", _part_salt(F.col("size") - F.col("k"), F.col("phrase")))
    copies = F.sequence(F.lit(0), F.when(F.col("size") == 1, SALTS - 1).otherwise(0))
    parts = counts.filter(f"size between 1 and {LONGEST - 1}").select("lang", "phrase", "f", F.explode(copies).alias("salt"))
    for part, name in (("first", "l"), ("rest", "r")):
        side = parts.select("lang", F.col("phrase").alias(part), F.col("salt").alias(f"{part}_salt"), F.col("f").alias(name))
        cut = cut.join(side, ["lang", part, f"{part}_salt"])
    deal = F.sequence(F.lit(0), F.lit(SALTS - 1))
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"), F.explode(deal).alias("deal"))
    exact = {name: F.col(name).cast("decimal(20,0)") for name in ("a", "l", "r", "n")}
    score = F.call_function("div", F.lit(1000) * exact["a"] * exact["n"], exact["l"] * exact["r"])
    cut = cut.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    cut = cut.join(totals, ["lang", "deal"]).withColumn("score", score)
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cut.groupBy("lang", "phrase", "a", "n").agg(best).select(
        "lang", "phrase", "a", "best.l", "best.r", "n", "best.score"
    )


def first_of_each(phrases: DataFrame, rows: int = FIRST_ROWS) -> DataFrame:
    """``phrases`` with rank, the first ``rows`` of each language.

    Each of ``FANOUT`` parts of a language is cut to as many before they meet.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(FANOUT))
    near = phrases.withColumn("part", part)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    near = near.filter(F.col("rank") <= rows).drop("part", "rank")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= rows)


def collocations(docs: DataFrame, least: int = LEAST, rows: int = FIRST_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first ``rows`` phrases of each language of ``docs`` (text, lang).

    A null text has no words; null languages are one, ``und``, together with
    those so named. Repeated rows each count. Texts without words, and an empty
    table, add nothing. No other columns are read.
    """
    chunks = cut_lineage(dictionary(docs.select("text", "lang")), "chunks")
    words = chunks.agg(F.sum("own")).first()[0] or 0
    counts = cut_lineage(phrase_counts(chunks, sieve_bits(words), least), "phrases")
    best = first_of_each(scored(maximal(counts), counts), rows)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
