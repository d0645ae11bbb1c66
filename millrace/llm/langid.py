"""Language of a text: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (other characters count as one space) are hashed
to ``BUCKETS`` columns. Document frequencies cover all training documents. The
weights are fitted by follow-the-regularised-leader with an elastic net (L1
keeps them sparse, L2 small) on a sample of at most about ``SAMPLE`` documents of
each language, and a temperature fitted on a fifth of the sample, left out of the
fit, calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from millrace.llm.words import fold_remainder, ids_of
from millrace.session import cut_lineage

BUCKETS = 1 << 15
ORDERS = 3
FOLDS = 5
SAMPLE = 1000
# Every language with a labelled training text is a class; more than these are an error.
MOST_LANGUAGES = 1000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
UNKNOWN = "und"
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of the n-grams of a text and how often each occurs; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(_SPACE))
    again = np.zeros(len(codes), bool)
    again[1:] = ~(letter[1:] | letter[:-1])
    codes = codes[~again]
    grams, mixed = [], np.zeros(len(codes), np.uint32)
    for order in range(ORDERS):
        if len(codes) > order:
            mixed = (mixed[: len(codes) - order] ^ codes[order:]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            grams.append(mixed & np.uint32(BUCKETS - 1))
    counts = np.bincount(np.concatenate(grams), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Columns and TF-IDF values of unit length, the constant column last."""
        counted = ngram_counts(text)
        if counted is None:
            return None
        values = (1 + np.log(counted[1])) * self.idf[counted[0]]
        values /= np.sqrt((values * values).sum())
        return np.append(counted[0], BUCKETS), np.append(values, 1.0)

    def probabilities(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        return softmax(self.weights[:, columns] @ values / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max())
    return raised / raised.sum()


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-Proximal with elastic net, one row (class, columns, values) at a time."""
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(epochs):
        for label, columns, values in rows:
            before = n[:, columns]
            weights = solved(z[:, columns], before)
            error = softmax(weights @ values)
            error[label] -= 1
            gradient = error[:, None] * values
            after = before + gradient * gradient
            z[:, columns] += gradient - (np.sqrt(after) - np.sqrt(before)) / ALPHA * weights
            n[:, columns] = after
    return solved(z, n)


def fit_temperature(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> float:
    """The temperature with the least log loss on ``rows``; 1 without rows."""
    if not rows:
        return 1.0
    logits = np.array([model.weights[:, columns] @ values for _, columns, values in rows])
    labels = np.array([label for label, _, _ in rows])

    def loss(temperature: float) -> float:
        scaled = logits / temperature
        scaled -= scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean())

    return float(min(np.geomspace(0.05, 5, 60), key=loss))


def _remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _survey(training: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Documents of each language and document frequency of each bucket, over all training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, langs = np.zeros(BUCKETS, np.int64), {}
        for batch in batches:
            for lang, text in zip(ids_of(batch, 0), ids_of(batch, 1), strict=True):
                counted = ngram_counts(text)
                if counted is not None:
                    langs[lang] = langs.get(lang, 0) + 1
                    there[counted[0]] += 1
        found = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(langs) + [None] * len(found), pa.string()),
                pa.array([None] * len(langs) + found.tolist(), pa.int32()),
                pa.array(list(langs.values()) + there[found].tolist(), pa.int64()),
            ],
            ["lang", "bucket", "n"],
        )

    counted = cut_lineage(
        training.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")),
        "ngram-documents",
    )
    langs = counted.filter("lang is not null").select("lang", "n").limit(MOST_LANGUAGES + 1).collect()
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages label documents")
    frequency = np.zeros(BUCKETS)
    for bucket, n in counted.filter("lang is null").select("bucket", "n").collect():
        frequency[bucket] = n
    return dict(map(tuple, langs)), frequency


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model learned from ``docs`` (doc_id, text, lang); None without a labelled text.

    Learns from rows with a language whose id is not in fold 0. About ``sample``
    documents of each language, chosen by the hash of their ids, reach the fit.
    Every language is a class, however small its share; more than
    ``MOST_LANGUAGES`` raise an error.
    """
    training = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder(F.col("doc_id")) != 0))
    langs, frequency = _survey(training.select("lang", "text"))
    if not langs:
        return None
    names = sorted(langs)
    idf = np.log((1 + sum(langs.values())) / (1 + frequency)) + 1
    share = F.create_map(*[x for lang in names for x in (F.lit(lang), F.lit(min(1.0, sample / langs[lang])))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    chosen = training.filter(F.col("lang").isin(names) & drawn).select("doc_id", "lang", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fitted, left = Model(names, idf, np.zeros((len(names), BUCKETS + 1))), [], []
        places = {lang: at for at, lang in enumerate(names)}
        for batch in batches:
            for doc_id, lang, text in zip(*(ids_of(batch, i) for i in range(3)), strict=True):
                found = model.features(text)
                if found is not None:
                    key = xxh3_64_intdigest(str(doc_id))
                    (left if key % 5 == 0 else fitted).append((key, places[lang], *found))
        fitted, left = ([row[1:] for row in sorted(rows, key=lambda r: r[:2])] for rows in (fitted, left))
        model.weights = fit_weights(fitted, len(names))
        model.temperature = fit_temperature(model, left)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.temperature])],
            ["weights", "temperature"],
        )

    row = chosen.repartition(1).mapInArrow(fit, "weights binary, temperature double").first()
    weights = np.frombuffer(row[0], np.float32).reshape(len(names), BUCKETS + 1)
    return Model(names, idf, weights, row[1])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs`` (doc_id, text).

    A null text, a text without letters, and any text without a model is ``und``
    with score 0. Equal probabilities go to the first language by name. Repeated
    rows each give a row; an empty table an empty result; a null id counts as
    empty text in the fold. No other columns are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [], []
            for text in ids_of(batch, 1):
                found = model.features(text) if model is not None and text is not None else None
                if found is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    chances = model.probabilities(*found)
                    langs.append(model.langs[int(chances.argmax())])
                    scores.append(float(chances.max()))
            held = [fold_remainder(doc_id, FOLDS) == 0 for doc_id in ids_of(batch, 0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(held), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``predict`` for every row of ``docs`` (doc_id, text, lang) by the model learned from them."""
    return predict(docs, train(docs, sample))
