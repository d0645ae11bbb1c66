"""Quality rules: counts per document and divergence from language references.

The references are the histograms of each language over all its documents: byte
classes (case, digits, symbols, spaces, beyond ASCII) and common words, those
that make up at least ``COMMON`` of a language's words. A word with that share
overall has it in at least one batch, so one pass proposes the words and a
second counts them exactly; nothing depends on how the rows are dealt out.

A document is compared with every reference by Jensen-Shannon distance (base 2)
and judged by the nearest. Short documents make noisy histograms and are passed, and
so are documents in a language with too few words for a reference of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.words import WordHashes, characters, ids_of, texts_of, window_hashes
from millrace.session import cut_lineage

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"

COMMON = 0.002
# Fewer words make a reference that strays from its language by more than WORD_NOISE / sqrt(REFERENCE_WORDS) = 0.04.
REFERENCE_WORDS = 2000
MOST_LANGUAGES = 1000
GUARD_CHARACTERS = 200
GUARD_WORDS = 40
# A histogram of n draws strays from its source by about 1 / sqrt(n).
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.22
WORD_NOISE = 1.8

LOWER, UPPER, DIGIT, SPACE, MARK, SYMBOL, BEYOND, CONTROL = range(8)
CLASSES = 8


def _byte_classes() -> np.ndarray:
    """Class of every byte; -1 for the bytes that continue a character."""
    kinds = np.full(256, MARK)
    kinds[:32], kinds[127] = CONTROL, CONTROL
    kinds[list(WHITE)] = SPACE
    kinds[ord("a") : ord("z") + 1], kinds[ord("A") : ord("Z") + 1] = LOWER, UPPER
    kinds[ord("0") : ord("9") + 1] = DIGIT
    kinds[list(SYMBOLS + b"@=+_~^\\`{}[]")] = SYMBOL
    kinds[0xC0:], kinds[0x80:0xC0] = BEYOND, -1
    return kinds


_KINDS = _byte_classes()
# Lower-cased words of letters only, for the word histogram.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def class_histogram(text: bytes) -> np.ndarray:
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(_KINDS[_KINDS >= 0], counts[_KINDS >= 0], CLASSES)


def js_distance(left: np.ndarray, right: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms in base 2, 0 to 1; 1 if either is empty."""
    if not left.sum() or not right.sum():
        return 1.0
    p, q = left / left.sum(), right / right.sum()
    mean = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(p > 0, p * np.log2(p / mean), 0).sum() + np.where(q > 0, q * np.log2(q / mean), 0).sum()
    return float(np.sqrt(max(0.0, gain / 2)))


def repeated_words(words: list[bytes], cache: WordHashes, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    hashes = window_hashes(cache.of(words), window)
    if len(hashes) < 2:
        return 0
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return 0
    again = np.zeros(len(hashes), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    steps[:-window + 1 if window > 1 else None][: len(again)] += again
    np.subtract.at(steps, np.flatnonzero(again) + window, 1)
    return int((np.cumsum(steps)[:-1] > 0).sum())


def base_counts(text: bytes, cache: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        characters(text, WHITE),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words, cache),
    )


@dataclass
class Reference:
    lang: str
    classes: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray

    def distances(self, classes: np.ndarray, words: Counter, total: int) -> tuple[float, float]:
        counts = np.zeros(len(self.shares))
        for word, at in self.words.items():
            counts[at] = words.get(word, 0)
        counts[-1] = total - counts.sum()
        return js_distance(classes, self.classes), js_distance(counts, self.shares)


def language_references(docs: DataFrame, common: float = COMMON, least: int = REFERENCE_WORDS) -> list[Reference]:
    """References of the languages whose documents hold at least ``least`` words, whatever their share.

    At most ``MOST_LANGUAGES`` languages, more raise an error, of at most ``1 / common``
    words each, so the result fits the driver whatever the input.
    """
    known = docs.filter("lang is not null and text is not null").select("lang", "text")

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for lang, text in zip(ids_of(batch, 0), texts_of(batch, 1), strict=True):
                entry = found.setdefault(lang, [0, Counter(), np.zeros(CLASSES)])
                entry[0] += 1
                entry[1].update(text.translate(_LETTERS).split())
                entry[2] += class_histogram(text)
            rows = []
            for lang, (count, words, classes) in found.items():
                total = sum(words.values())
                rows.append((lang, None, count, total, [int(c) for c in classes]))
                rows += [(lang, word, 0, 0, None) for word, n in words.items() if n >= common * total]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds, strict=True)], names)

    names = ["lang", "word", "docs", "total", "classes"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(CLASSES)]
    surveyed = cut_lineage(
        known.mapInArrow(survey, "lang string, word binary, docs long, total long, classes array<long>")
        .groupBy("lang", "word")
        .agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"), *sums),
        "language-words",
    )
    heads = surveyed.filter("word is null")
    kept = {row["lang"]: row for row in heads.filter(F.col("total") >= least).limit(MOST_LANGUAGES + 1).collect()}
    if len(kept) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages have {least} words")
    proposals: dict[str, set[bytes]] = {lang: set() for lang in kept}
    for row in surveyed.filter(F.col("word").isNotNull() & F.col("lang").isin(list(kept))).select("lang", "word").collect():
        proposals[row[0]].add(bytes(row[1]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(ids_of(batch, 0), texts_of(batch, 1), strict=True):
                if lang in proposals:
                    counts.setdefault(lang, Counter()).update(
                        filter(proposals[lang].__contains__, text.translate(_LETTERS).split())
                    )
        rows = [(lang, word, n) for lang, words in counts.items() for word, n in words.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"]
        )

    counted = known.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    numbers: dict[str, dict[bytes, int]] = {lang: {} for lang in kept}
    for lang, word, n in counted.collect():
        if n >= common * kept[lang]["total"]:
            numbers[lang][bytes(word)] = n
    references = []
    for lang in sorted(kept):
        words = sorted(numbers[lang])
        shares = np.array([numbers[lang][word] for word in words] + [kept[lang]["total"] - sum(numbers[lang].values())], float)
        classes = np.array([kept[lang][f"c{i}"] for i in range(CLASSES)], float)
        references.append(Reference(lang, classes, {word: at for at, word in enumerate(words)}, shares))
    return references


def nearest(text: bytes, references: list[Reference]) -> tuple[str | None, float | None, float | None]:
    """The reference with the least sum of distances, and its distances for classes and words."""
    classes = class_histogram(text)
    words = text.translate(_LETTERS).split()
    counted, best = Counter(words), (None, None, None)
    for reference in references:
        by_class, by_word = reference.distances(classes, counted, len(words))
        if best[1] is None or by_class + by_word < best[1] + best[2]:
            best = (reference.lang, by_class, by_word)
    return best


def judge(text: bytes | None, label: str | None, references: list[Reference], cache: WordHashes) -> tuple:
    """The row of measurements and verdicts of one text; ``label`` is its language if known."""
    text = text or b""
    counts = base_counts(text, cache)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]
    lang, by_class, by_word = None, None, None
    comparable = label is None or any(reference.lang == label for reference in references)
    if comparable and counts[0] >= GUARD_WORDS and counts[1] >= GUARD_CHARACTERS:
        lang, by_class, by_word = nearest(text, references)
    allowed = MAX_WORD_DISTANCE + WORD_NOISE / max(1, counts[0]) ** 0.5
    diverges = by_class is not None and (by_class > MAX_CLASS_DISTANCE or by_word > allowed)
    return (*counts, failed, not failed and not diverges, lang, by_class, by_word)


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, reference_lang string, class_distance double, word_distance double"
)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the distances for every row of ``docs`` (doc_id, text, lang).

    A null text counts as empty: no words, so base_failed. Distances are null
    below the length guards and where the document's language has no reference,
    and such documents pass the method. Rows without a language are judged by the
    nearest reference like the rest. Repeated rows each give a row; an empty table an empty
    result. No other columns are read.
    """
    references = language_references(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = StructType.fromDDL(RESULT)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
        for batch in batches:
            rows = [judge(t, label, references, cache) for t, label in zip(texts_of(batch, 1), ids_of(batch, 2), strict=True)]
            columns = [pa.array([row[i] for row in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *fields.fieldNames()])

    return docs.select("doc_id", "text", "lang").mapInArrow(report, f"doc_id {kind}, {RESULT}")


def without_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they have."""
    references = language_references(docs)
    at, by = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            judged = [judge(t, label, references, cache) for t, label in zip(texts_of(batch, at), ids_of(batch, by), strict=True)]
            yield batch.filter(pa.array([row[6] for row in judged], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
