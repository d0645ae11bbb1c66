import random
import time

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import similarity
from millrace.functions.similarity import distance_of, edit_distance, edit_similarity


def by_table(left, right):
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(right, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return row[-1]


TEXT = st.text("abé😀", max_size=90)


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.none() | st.integers(0, 90))
@example("", "", 0)
@example("a" * 70, "", None)
@example("a" * 64, "b" * 64, None)
@example("ab" * 40, "ba" * 40, 3)
def test_distance_against_the_whole_table(left, right, limit):
    wanted = by_table(left, right)
    assert distance_of(left, right, limit) == (wanted if limit is None else min(wanted, limit))


def test_early_end_gives_the_same(monkeypatch):
    draw = random.Random(2)
    pairs = [("".join(draw.choices("abcd", k=draw.randrange(200))), "".join(draw.choices("cdef", k=draw.randrange(200)))) for _ in range(80)]
    for look in (1, 7, 256):
        monkeypatch.setattr(similarity, "LOOK", look)
        for left, right in pairs:
            assert distance_of(left, right, 60) == min(60, by_table(left, right))


def test_columns_against_the_built_in(spark):
    draw = random.Random(4)
    rows = [("".join(draw.choices("ab é\n", k=draw.randrange(60))), "".join(draw.choices("ab é\n", k=draw.randrange(60)))) for _ in range(300)]
    rows += [(None, "a"), ("a", None), (None, None), ("", ""), ("x", ""), ("", "x"), ("same", "same")]
    frame = spark.createDataFrame(rows, "a string, b string")
    assert frame.filter(~edit_distance("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0
    for divisor in ("left", "right"):
        short = edit_similarity("a", "b", divisor)
        full = edit_similarity("a", "b", divisor, distance=F.levenshtein("a", "b"))
        assert frame.select(short.alias("s"), full.alias("f")).filter("not (s <=> f)").count() == 0


@pytest.mark.parametrize("alike", [True, False])
def test_texts_of_a_hundred_thousand_characters(alike):
    draw = random.Random(9)
    left = draw.choices("abcdefgh ", k=100_000)
    right = list(left) if alike else draw.choices("abcdefgh ", k=100_000)
    for at in draw.sample(range(100_000), 50):
        right[at] = "#"
    start = time.process_time()
    found = distance_of("".join(left), "".join(right))
    # About 5 seconds on one core at rest.
    assert time.process_time() - start < 20
    assert found == 50 if alike else found > 50_000
