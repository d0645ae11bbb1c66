"""Packing in a given order against the packing rules, row by row."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_packing import fold

from millrace.operators.ordered_packing import Fill, bins_in_order, buffer_numbers, plan_in_order


def filled(lengths, fill, capacity):
    """Fill at the end and closed buffers, row by row."""
    closed = 0
    for length in lengths:
        fill += length
        if fill >= capacity:
            fill, closed = 0, closed + 1
    return fill, closed


LENGTHS = st.lists(st.integers(1, 30), max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(LENGTHS.filter(bool), min_size=1, max_size=5), st.integers(1, 40))
def test_composed_functions_against_rows(chunks, capacity):
    fills = [Fill.of(np.array(chunk), capacity) for chunk in chunks]
    together = fills[0]
    for fill in fills[1:]:
        together = together.then(fill, capacity)
    # Composition does not hang on how the chunks are grouped.
    if len(fills) > 2:
        right = fills[-2].then(fills[-1], capacity)
        for fill in fills[-3::-1]:
            right = fill.then(right, capacity)
        assert np.array_equal(right.start, together.start) and np.array_equal(right.end, together.end)
    entering = np.arange(capacity)
    end, closed = together.after(entering)
    rows = [length for chunk in chunks for length in chunk]
    assert [(int(a), int(b)) for a, b in zip(end, closed)] == [filled(rows, fill, capacity) for fill in range(capacity)]
    assert len(together.start) <= capacity and (np.diff(together.start) > 0).all()


@settings(max_examples=150, deadline=None)
@given(LENGTHS, st.integers(1, 12), st.integers(1, 4))
def test_buffers_and_bins_against_rows(lengths, max_length, factor):
    sizes, capacity = np.array(lengths, np.int64), max_length * factor
    numbers = buffer_numbers(sizes, 0, 0, capacity)
    found = []
    for buffer in sorted(set(numbers.tolist())):
        columns = bins_in_order(sizes[numbers == buffer], max_length, capacity)
        found += [(buffer, *row) for row in zip(*(c.tolist() for c in columns))]
    assert found == fold(lengths, max_length, factor)


def plan(frame, max_length, **options):
    rows = plan_in_order(frame, max_length, **options).collect()
    held = {}
    for row in rows:
        held.setdefault((row["part"], row["split"]), []).append((row["row_id"], row["seq_length"], row["buffer"], row["bin"], row["pos"], row["residual"]))
    return {unit: sorted(own) for unit, own in held.items()}


def test_units_of_any_size_over_many_tasks(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(0, 0, i * 7 - 3000, int(draw.integers(1, 60))) for i in range(4000)]
    rows += [(part, 1, i, int(draw.choice([1, 5, 50, 900]))) for part in range(3) for i in range(part * 40 + 1)]
    frame = spark.createDataFrame(rows, "part int, split int, row_id long, seq_length int").orderBy(F.rand(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        found = plan(frame, 50, buffer_factor=3, together=3, buffers_together=2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for unit in {row[:2] for row in rows}:
        own = sorted(row[2:] for row in rows if row[:2] == unit)
        wanted = fold([length for _, length in own], 50, 3)
        assert found[unit] == [(i, length, *place) for (i, length), place in zip(own, wanted)]


def test_text_order_other_columns_and_empty(spark):
    rows = [(0, 0, f"{i:03d}", 1 + i * 37 % 90, "kept") for i in range(200)]
    frame = spark.createDataFrame(rows, "part int, split int, row_id string, seq_length int, fill string")
    assert {r["fill"] for r in plan_in_order(frame, 64).collect()} == {"kept"}
    found = plan(frame, 64)[0, 0]
    assert [row[2:] for row in found] == fold([row[3] for row in rows], 64)
    assert plan_in_order(frame.limit(0), 64).count() == 0
