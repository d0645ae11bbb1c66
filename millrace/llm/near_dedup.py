"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

Documents with equal word sequences are folded into one representative first.
Every representative has a MinHash signature; documents that agree on all rows
of a band share a bucket. A bucket does not emit all its pairs: its members are
compared with one centre, the member that shares most with others, and links
are joined to components. What a bucket still holds apart gets an exact way: the
members' shingles are ordered by rarity, and only members of different
components that share one of the rarest, as any two similar sets must, are
compared. Variants of one text that are too far apart share none of these.

A pair of candidates is compared a batch of hashes at a time. After each batch
the posterior probability (uniform prior) that its similarity reaches the
threshold, given the agreements so far, decides whether it is dropped; survivors
are confirmed on their whole shingle sets. Sets hold 64-bit window hashes.

A pair at the threshold itself shares no band with probability
``(1 - threshold ** rows) ** bands`` (5e-7 with the defaults), and is dropped by
the posterior bound with at most ``miss`` per batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import component_labels
from millrace.llm.words import WordHashes, ids_of, per_batch, shingle_set, texts_of
from millrace.session import cut_lineage

WORDS = 5
BANDS = 25
ROWS = 5
MISS = 1e-6
# Near copies in general, where no contract names a threshold; a pair at 0.8 shares no band with probability 6e-7.
GENERAL_THRESHOLD = 80
GENERAL_BANDS = 36
CELLS = 1 << 16
_SHINGLES_AT_ONCE = 4096


def _hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    factors = draw.integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return factors[:, None], draw.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least value of every hash function over the shingles."""
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(folded), _SHINGLES_AT_ONCE):
        values = folded[None, start : start + _SHINGLES_AT_ONCE] * factors
        values += shifts
        np.minimum(least, values.min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, words: int = WORDS, hashes: int = BANDS * ROWS) -> DataFrame:
    """doc_id, digest of the word sequence, n_shingles and signature of ``docs`` (doc_id, text)."""

    def mark(batch: pa.RecordBatch):
        cache, (factors, shifts) = WordHashes(), _hash_family(hashes)
        digests, counts, signs = [], [], []
        for text in texts_of(batch, 1):
            split = (text or b"").lower().split()
            found = shingle_set(cache.of(split), words)
            digests.append(blake2b(b" ".join(split), digest_size=16).digest())
            counts.append(len(found))
            signs.append(signature(found, factors, shifts).tobytes() if len(found) else None)
        return [batch.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(signs, pa.binary())]

    return per_batch(docs, mark, "doc_id long, digest binary, n_shingles long, signature binary")


def _banded(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """bucket, rep and n_shingles, one row for every band of a representative."""

    def split(batch: pa.RecordBatch):
        signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32)
        signs = signs.reshape(batch.num_rows, -1)[:, : bands * rows].reshape(batch.num_rows, bands, rows)
        mixed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), signs.shape[:2]).copy()
        for row in range(rows):
            mixed ^= signs[:, :, row]
            mixed *= np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(31)
        return [
            pa.array(mixed.astype(np.int64).ravel()),
            pa.array(np.repeat(batch.column(0).to_numpy(), bands)),
            pa.array(np.repeat(batch.column(1).to_numpy(), bands)),
        ]

    return per_batch(reps.select("rep", "n_shingles", "signature"), split, "bucket long, rep long, n_shingles long")


def least_agreements(hashes: int, threshold: float, miss: float) -> int:
    """Fewest agreements of ``hashes`` at which the posterior of reaching ``threshold`` is at least ``miss``."""
    below = 0.0
    for agreed in range(hashes + 1):
        below += comb(hashes + 1, agreed) * threshold**agreed * (1 - threshold) ** (hashes + 1 - agreed)
        if below >= miss:
            return agreed
    return hashes


def _plausible(pairs: DataFrame, reps: DataFrame, bands: int, rows: int, threshold: float, miss: float) -> DataFrame:
    """The pairs that no batch of signature rows rules out."""
    batches = [(end, least_agreements(end, threshold, miss)) for end in range(rows * 5, bands * rows + 1, rows * 5)]
    one = reps.select(F.col("rep").alias("a"), F.col("signature").alias("sign_a"))
    other = reps.select(F.col("rep").alias("b"), F.col("signature").alias("sign_b"))

    def compare(batch: pa.RecordBatch):
        left, right = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3)
        )
        alive, agreed, start = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
        for end, least in batches:
            agreed[alive] += (left[alive, start:end] == right[alive, start:end]).sum(axis=1)
            alive, start = alive[agreed[alive] >= least], end
        return [batch.column(0).take(pa.array(alive)), batch.column(1).take(pa.array(alive))]

    signed = pairs.join(one, "a").join(other, "b").select("a", "b", "sign_a", "sign_b")
    return per_batch(signed, compare, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs whose whole sets have at least ``threshold`` percent in common."""
    both = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def confirm(batch: pa.RecordBatch):
        cache, kept = WordHashes(), []
        last, last_set = None, None
        for row, (text_a, text_b) in enumerate(zip(texts_of(batch, 2), texts_of(batch, 3), strict=True)):
            if text_a != last:
                last, last_set = text_a, shingle_set(cache.of((text_a or b"").lower().split()), words)
            found = shingle_set(cache.of((text_b or b"").lower().split()), words)
            common = len(np.intersect1d(last_set, found, assume_unique=True))
            if common and 100 * common >= threshold * (len(last_set) + len(found) - common):
                kept.append(row)
        return [batch.column(i).take(pa.array(kept, pa.int64())) for i in (0, 1)]

    return per_batch(both.select("a", "b", "text_a", "text_b"), confirm, "a long, b long").distinct()


def _rarity(texts: DataFrame, words: int) -> np.ndarray:
    """How often shingles fall into each of CELLS cells, over all ``texts``; any such table orders shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, cache = np.zeros(CELLS, np.int64), WordHashes()
        for batch in batches:
            for text in texts_of(batch, 0):
                found = shingle_set(cache.of((text or b"").lower().split()), words)
                np.add.at(cells, found % np.uint64(CELLS), 1)
        used = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(cells[used])], ["cell", "n"])

    rows = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()
    cells = np.zeros(CELLS, np.int64)
    for cell, number in rows:
        cells[cell] = number
    return cells


def _prefixes(texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """shingle, rep, label, n and place for the rarest shingles of ``texts`` (rep, label, text).

    A set of n shingles keeps so many that a similar set must share one of them.
    """
    cells = texts.sparkSession.sparkContext.broadcast(_rarity(texts, words))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for rep, label, text in zip(ids_of(batch, 0), ids_of(batch, 1), texts_of(batch, 2), strict=True):
                found = shingle_set(cache.of((text or b"").lower().split()), words)
                kept = len(found) + threshold * len(found) // -100 + 1
                first = found[np.lexsort((found, cells.value[found % np.uint64(CELLS)]))][:kept]
                for column, values in zip(
                    rows,
                    (first.astype(np.int64), [rep] * len(first), [label] * len(first), [len(found)] * len(first), range(1, len(first) + 1)),
                    strict=True,
                ):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["shingle", "rep", "label", "n", "place"])

    schema = "shingle long, rep long, label long, n long, place long"
    return texts.select("rep", "label", "text").mapInArrow(rank, schema)


def _crossing(prefixes: DataFrame, threshold: int) -> DataFrame:
    """Pairs of different components that may be similar: every component but a shingle's largest against the rest."""
    sizes = prefixes.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("size"))
    main = (
        sizes.groupBy("shingle")
        .agg(F.max(F.struct("size", "label")).getField("label").alias("main"), F.count(F.lit(1)).alias("labels"))
        .filter("labels > 1")
        .select("shingle", "main")
    )
    shared = cut_lineage(prefixes.join(main, "shingle"), "shared-shingles")
    apart = shared.filter("label <> main").select("shingle", *[F.col(c).alias(f"{c}_a") for c in ("rep", "label", "n", "place")])
    needed = F.expr(f"ceil({threshold} * (n + n_a) / {100 + threshold}.0)")
    return (
        apart.join(shared, "shingle")
        .filter((F.col("label") != F.col("label_a")) & (1 + F.expr("least(n - place, n_a - place_a)") >= needed))
        .select(F.least("rep", "rep_a").alias("a"), F.greatest("rep", "rep_a").alias("b"))
    )


def near_duplicates(
    docs: DataFrame, threshold: int = 85, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, miss: float = MISS
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and are linked with nothing; so are
    rows without id, which stay (component null, kept). Rows of one id count as
    one document. Other columns of ``docs`` are not read. An empty table gives
    an empty result. ``threshold`` is the least similarity in percent.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = cut_lineage(signatures(source, words, bands * rows), "signatures")
    reps = cut_lineage(
        marked.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")),
        "representatives",
    )
    buckets = cut_lineage(_banded(reps, bands, rows), "buckets")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = cut_lineage(buckets.join(sizes, "bucket"), "shared-buckets")
    weights = shared.groupBy("rep").agg(F.sum("size").alias("weight"))
    centres = cut_lineage(
        shared.join(weights, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"), "n_shingles")).alias("top"))
        .select("bucket", (-F.col("top.least")).alias("centre"), F.col("top.n_shingles").alias("n_centre")),
        "centres",
    )
    # The same kind of join at every size: the texts are dealt out once.
    asked = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = cut_lineage(
        source.hint("merge").join(asked, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep"), "candidate-texts"
    )

    def link(pairs: DataFrame) -> DataFrame:
        plausible = cut_lineage(_plausible(pairs.distinct(), reps, bands, rows, threshold / 100, miss), "plausible")
        return cut_lineage(_confirmed(plausible, texts, words, threshold), "links")

    starred = shared.join(centres, "bucket").filter("rep <> centre")
    near = F.expr(f"100 * least(n_shingles, n_centre) >= {threshold} * greatest(n_shingles, n_centre)")
    links = link(starred.filter(near).select(F.col("centre").alias("a"), F.col("rep").alias("b")))
    labels = component_labels(links).withColumnRenamed("node", "rep")

    placed = cut_lineage(
        starred.join(labels, "rep", "left").select("bucket", "rep", F.coalesce("label", "rep").alias("label")), "placed"
    )
    open_buckets = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    apart = placed.join(open_buckets.select("bucket"), "bucket", "left_semi").select("rep", "label").distinct()
    prefixes = cut_lineage(_prefixes(cut_lineage(texts.join(apart, "rep"), "open-texts"), words, threshold), "prefixes")
    labels = component_labels(links.union(link(_crossing(prefixes, threshold)))).withColumnRenamed("node", "rep")

    component = F.when(F.col("n_shingles") > 0, F.coalesce("label", "rep", "doc_id")).otherwise(F.col("doc_id"))
    return (
        marked.select("doc_id", "digest", "n_shingles")
        .join(reps.select("digest", "rep"), "digest", "left")
        .join(labels, "rep", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def without_copies(docs: DataFrame, threshold: int = GENERAL_THRESHOLD, bands: int = GENERAL_BANDS) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with the columns they have; one row of each repeated id."""
    found = cut_lineage(near_duplicates(docs, threshold, bands=bands), "near-duplicates")
    copies = found.filter("not kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    rest = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    repeated = cut_lineage(
        found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids"
    )
    if repeated.isEmpty():
        return rest
    again = rest.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return rest.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(again)
