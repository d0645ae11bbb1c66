"""Language-model scores of documents: unigram counts and a gated recurrent model over them.

Tokens are lower-cased words and one end a document, split and hashed for whole
columns of texts; a word is its 64-bit hash. Counts cover all training documents. The commonest tokens, at most ``FREQUENT``, go to every task; the rest
are looked up by a join, in which no key is frequent. The recurrent model knows the
commonest ``VOCABULARY`` tokens and one id for all others, whose probability is
shared out by their counts. Its weights are averages of copies that each read one
part of the training documents; together they read them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.collocations import bytes_of, slices
from millrace.llm.gru import Model, Trainer
from millrace.session import cut_lineage

FOLDS, HELD_OUT = 7, 2
FREQUENT = 1 << 17
VOCABULARY = 1022
TRAIN_SHARE = 1
COUNT_TOKENS = 4_000_000
TRAIN_TOKENS = 500_000
SCORE_TOKENS = 4_000_000
BLOCK = 4096
FANOUT = 64
# Longer words, in bytes, are hashed one by one.
LONG_WORD = 64
_MIX, _LENGTH, _SHIFT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(32)
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    for _ in range(2):
        values = (values ^ values >> _SHIFT) * _MIX
    return values ^ values >> _SHIFT


def word_hashes(words: pa.Array) -> np.ndarray:
    """A signed 64-bit hash of each word: eight bytes of all words at once, then the next eight of those that go on."""
    data, offsets = bytes_of(words)
    lengths, at = np.diff(offsets), offsets[:-1]
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    hashes = _mixed((eights[at] & _FIRST_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _LENGTH)
    for done in range(8, LONG_WORD, 8):
        on = np.flatnonzero((lengths > done) & (lengths <= LONG_WORD))
        hashes[on] = _mixed(hashes[on] ^ eights[at[on] + done] & _FIRST_BYTES[np.minimum(lengths[on] - done, 8)])
    for i in np.flatnonzero(lengths > LONG_WORD):
        hashes[i] = xxh3_64_intdigest(words[i].as_buffer())
    return hashes.view(np.int64)


# No word is white space.
END = int(word_hashes(pa.array(["\n"]))[0])
FIRST, OTHER = 0, 1


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens (64-bit hashes) of some texts side by side, each text's end behind its words, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, ""), pa.scalar(None, pa.string()), trimmed))
    numbers = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.insert(word_hashes(lists.flatten()), np.cumsum(numbers), END), numbers + 1


def _training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS != HELD_OUT


def token_counts(training: DataFrame) -> DataFrame:
    """token (64-bit hash) and c over all of ``training`` (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def flush() -> pa.RecordBatch:
            tokens, numbers = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(numbers, pa.int64())], ["token", "n"])

        for batch in batches:
            for _, texts in slices(batch.column(0)):
                held.append(tokens_of(texts)[0])
                waiting += len(held[-1])
                if waiting > COUNT_TOKENS:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return training.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("c"))


def frequent_tokens(counts: DataFrame, most: int | None = None) -> list[tuple[int, int]]:
    """The commonest tokens and their counts, commonest first, at most ``most`` (FREQUENT).

    Counts are cut into levels of a sixteenth of a power of two, and whole levels
    taken from the top while there is room, so no task or driver sorts them all.
    """
    most = FREQUENT if most is None else most
    level = F.floor(F.log2("c") * 16)
    lowest, held = None, 0
    for at, number in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += number
        if held > most:
            break
        lowest = at
    if lowest is None:
        return []
    return sorted(map(tuple, counts.filter(level >= lowest).collect()), key=lambda row: (-row[1], row[0]))


class Lexicon:
    """The frequent tokens: their counts, and the model's id of the commonest; other tokens are rare."""

    def __init__(self, rows: list[tuple[int, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.counts = np.array([c for _, c in rows], np.int64)
        tokens = np.array([token for token, _ in rows], np.int64)
        self.ids = np.full(len(rows) + 1, OTHER, np.int32)
        self.ids[:-1][tokens == END] = FIRST
        known = np.flatnonzero(tokens[:VOCABULARY] != END)
        self.ids[known] = np.arange(len(known)) + 2
        self.order = np.argsort(tokens)
        self.tokens = tokens[self.order]
        modelled = self.ids[self.order] != OTHER
        self.model_tokens, self.model_ids = self.tokens[modelled], self.ids[self.order][modelled]
        inside = self.ids[:-1] != OTHER
        self.other_total = total - int(self.counts[inside].sum())
        self.other_distinct = distinct - int(inside.sum())
        self.model_counts = np.zeros(len(known) + 2)
        self.model_counts[self.ids[:-1][inside]] = self.counts[inside]
        self.model_counts[OTHER] = self.other_total

    def model(self) -> Model:
        return Model(self.model_counts)

    def places_of(self, tokens: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent ones, or -1."""
        return _found(self.tokens, self.order, tokens, -1)

    def ids_of(self, tokens: np.ndarray) -> np.ndarray:
        """The model's id of each token."""
        return _found(self.model_tokens, self.model_ids, tokens, OTHER)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    """The value of each of ``wanted`` by sorted ``keys``, or ``missing``."""
    if not len(keys):
        return np.full(len(wanted), missing, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], values.dtype.type(missing))


def _trained(training: DataFrame, lexicon, share: int) -> np.ndarray | None:
    """Weights averaged over copies that each read the documents of one task, by the tokens they read."""
    chosen = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).select("doc_id", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        trainer, held, waiting, read = Trainer(known.model()), [], 0, 0
        for batch in batches:
            for _, texts in slices(batch.column(1)):
                tokens, numbers = tokens_of(texts)
                for own in np.split(known.ids_of(tokens), np.cumsum(numbers)[:-1]):
                    held.append(own)
                    waiting += len(own)
                    if waiting > TRAIN_TOKENS:
                        read += trainer.read(held)
                        held, waiting = [], 0
        read += trainer.read(held) if held else 0
        packed = trainer.model.packed()
        starts = range(0, len(packed), BLOCK)
        copy = TaskContext.get().partitionId() % FANOUT
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(starts), pa.int64()),
                pa.array([copy] * len(starts), pa.int64()),
                pa.array([read] * len(starts), pa.int64()),
                pa.array([packed[at : at + BLOCK].tobytes() for at in starts], pa.binary()),
            ],
            ["block", "copy", "read", "weights"],
        )

    def average(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        read = np.array(table["read"].to_pylist(), np.float64)
        rows = np.array([np.frombuffer(w, np.float32) for w in table["weights"].to_pylist()], np.float64)
        order = np.lexsort((*rows.T[:2], read))
        mean = (read[order] @ rows[order] / max(1.0, read.sum())).astype(np.float32).tobytes()
        return pa.table(
            [[key[0].as_py()], [0 if len(key) == 1 else key[1].as_py()], [int(read.sum())], pa.array([mean], pa.binary())],
            ["block", "copy", "read", "weights"],
        )

    schema = "block long, copy long, read long, weights binary"
    copies = chosen.repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id").mapInArrow(fit, schema).filter("read > 0")
    some = copies.groupBy("block", "copy").applyInArrow(average, schema)
    rows = some.groupBy("block").applyInArrow(average, schema).collect()
    if not rows:
        return None
    return np.concatenate([np.frombuffer(row["weights"], np.float32) for row in sorted(rows, key=lambda r: r["block"])])


def _scored(docs: DataFrame, lexicon, weights) -> DataFrame:
    """One row for every row of ``docs``: what the frequent tokens and the model give, and the rare tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "n_tokens", "n_other", "n_known", "logs", "other_logs", "model_log", "rare"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        model = known.model()
        if weights.value is not None:
            model.unpack(weights.value)
        logs = np.append(np.log10(known.counts + 1.0), 0.0)
        row = TaskContext.get().partitionId() << 40

        def finish(ids: list, parts: list) -> pa.RecordBatch:
            nonlocal row
            chances = model.log_probabilities(ids) / np.log(10)
            doc_ids, *numbers, rare = zip(*parts, strict=True)
            rows = np.arange(row, row + len(ids))
            row += len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(rows, pa.int64()),
                    pa.concat_arrays(doc_ids),
                    *(pa.array(np.concatenate(part)) for part in numbers),
                    pa.array(chances, pa.float64()),
                    pa.concat_arrays(rare),
                ],
                names,
            )

        ids, parts, held = [], [], 0
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                tokens, numbers = tokens_of(texts)
                ends = np.cumsum(numbers)
                place = known.places_of(tokens)
                own, given = known.ids[place], logs[place]
                is_rare, is_other = place < 0, own == OTHER

                def by_text(values: np.ndarray, begins: np.ndarray = ends - numbers) -> np.ndarray:
                    return np.add.reduceat(values, begins)

                n_rare = by_text(is_rare.astype(np.int64))
                parts.append(
                    (
                        batch.column(0).slice(first, len(texts)),
                        numbers,
                        by_text(is_other.astype(np.int64)),
                        numbers - n_rare,
                        by_text(given),
                        by_text(np.where(is_other, given, 0.0)),
                        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_rare)), pa.int32()), pa.array(tokens[is_rare])),
                    )
                )
                ids += np.split(own, ends[:-1])
                held += len(tokens)
                if held > SCORE_TOKENS:
                    yield finish(ids, parts)
                    ids, parts, held = [], [], 0
        if ids:
            yield finish(ids, parts)

    return docs.mapInArrow(
        score,
        f"row long, doc_id {kind}, n_tokens long, n_other long, n_known long, logs double, other_logs double, "
        "model_log double, rare array<long>",
    )


def score_documents(docs: DataFrame, share: int = TRAIN_SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text).

    A null text counts as empty and has one token, its end. Repeated rows each
    give a row, and each counts in training. A null id counts as empty text in
    the fold. Without training documents all counts are 0, and the model's
    probabilities are those of an unread model. An empty table gives an empty
    result. All training documents train the recurrent model, unless ``share`` is
    more than 1: then one in so many, by the hash of its id. Counts cover all. No
    other columns are read.
    """
    spark = docs.sparkSession
    source = docs.select("doc_id", "text")
    training = source.filter(_training(F.col("doc_id")))
    counts = cut_lineage(token_counts(training), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    lexicon = spark.sparkContext.broadcast(Lexicon(frequent_tokens(counts), total, distinct))
    known = lexicon.value
    weights = spark.sparkContext.broadcast(_trained(training, lexicon, share))
    scored = cut_lineage(_scored(source, lexicon, weights), "scored")

    rare = scored.select("row", F.explode("rare").alias("token"))
    looked_up = (
        rare.join(counts, "token")
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    )
    rare_logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("logs") + rare_logs - F.col("n_tokens") * float(np.log10(total + distinct + 1))
    others = F.col("other_logs") + rare_logs - F.col("n_other") * float(np.log10(known.other_total + known.other_distinct + 1))
    return scored.drop("rare").join(looked_up, "row", "left").select(
        "doc_id",
        (~_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("model_log") + others).alias("score"),
    )
