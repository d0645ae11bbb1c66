import re
from collections import Counter

import numpy as np
import pytest
from conftest import prose, words_of

from millrace.llm.quality import js_distance, language_references, quality_report, without_rejected


def expected(text):
    text = text or ""
    words = words_of(text)
    seen, copies = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            copies += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    numbers, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if numbers[window] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(covered), failed


BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_against_brute_force(documents, texts):
    report = quality_report(documents).collect()
    assert {row["doc_id"]: tuple(row[c] for c in BASE[1:]) for row in report} == {d: expected(t) for d, t in texts.items()}
    assert not [row for row in report if row["base_failed"] and row["kept"]]


def test_repeats_ties_and_white_space(spark):
    line = prose(1, 9)
    ids = {1: f"{line}\n{line}\n\n \n{line}", 2: " ".join(["a"] * 50), 3: prose(2, 19), 4: prose(2, 20), 5: "a b c \x0bd\x0ce\rf", 6: "x y " * 8}
    frame = spark.createDataFrame([(d, t, "en") for d, t in ids.items()], "doc_id long, text string, lang string")
    assert {row["doc_id"]: tuple(row[c] for c in BASE[1:]) for row in quality_report(frame).collect()} == {d: expected(t) for d, t in ids.items()}


def test_references_do_not_depend_on_partitions(documents):
    one, many = (language_references(documents.repartition(n)) for n in (1, 13))
    assert [r.lang for r in one] == [r.lang for r in many]
    for left, right in zip(one, many, strict=True):
        assert left.words == right.words and (left.shares == right.shares).all() and (left.classes == right.classes).all()


def test_shouting_and_symbols_diverge_and_prose_stays(spark, documents):
    clean = {row["doc_id"]: row["kept"] for row in quality_report(documents).collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()
    good = [clean[row["doc_id"]] for row in labels if row["quality"] == 1]
    bad = [clean[row["doc_id"]] for row in labels if row["quality"] == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.2


def test_distance():
    assert js_distance(np.array([1, 0]), np.array([0, 3])) == pytest.approx(1)
    assert js_distance(np.array([2, 4]), np.array([1, 2])) == pytest.approx(0, abs=1e-7)
    assert js_distance(np.zeros(2), np.array([1, 2])) == 1.0


def test_odd_rows_and_empty(odd, nothing):
    report = quality_report(odd).collect()
    assert len(report) == odd.count()
    for row in report:
        if row["doc_id"] in (1, 2, 5):
            assert (row["n_words"], row["base_failed"], row["kept"], row["class_distance"]) == (0, True, False, None)
    assert without_rejected(odd).columns == odd.columns
    assert quality_report(nothing).count() == 0 and without_rejected(nothing).count() == 0


def test_languages_of_a_small_share_are_not_rejected(spark):
    draw = np.random.default_rng(6)
    stock = {lang: [f"{lang}{chr(97 + i)}{chr(97 + i % 7)}" for i in range(20)] for lang in ("big", "small", "tiny")}
    rows = []
    for lang, number in (("big", 6000), ("small", 40), ("tiny", 2)):
        rows += [(len(rows) + i, " ".join(draw.choice(stock[lang], 80)), lang) for i in range(number)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    report = quality_report(frame).collect()
    assert all(row["kept"] for row in report) and without_rejected(frame).count() == len(rows)
    assert {row["reference_lang"] for row in report[6000:6040]} == {"small"}
    assert [(row["reference_lang"], row["word_distance"]) for row in report[6040:]] == [(None, None)] * 2
