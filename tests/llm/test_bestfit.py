import numpy as np
import pytest
from conftest import words_of

from millrace.llm.bestfit import best_fit, default_cost, opened_capacity, plan_bins, token_counts


def one_by_one(lengths, capacities):
    """Best fit of single pieces in descending length; the contents of every bin with its capacity."""
    bins, left = [], np.bincount(lengths, minlength=max(capacities) + 1)
    for length in sorted(set(lengths), reverse=True):
        opened = opened_capacity(length, capacities, default_cost, np.cumsum(left * np.arange(len(left))))
        for _ in range(left[length]):
            fitting = [b for b in bins if b[0] >= length]
            if fitting:
                chosen = min(fitting, key=lambda b: b[0])
            else:
                chosen = [opened, opened, []]
                bins.append(chosen)
            chosen[0] -= length
            chosen[2].append(length)
        left[length] = 0
    return sorted((tuple(b[2]), min(c for c in capacities if c >= sum(b[2]))) for b in bins)


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_best_fit(spark, seed):
    draw = np.random.default_rng(seed)
    capacities = [(64,), (16, 32, 64), (40, 64, 100)][seed % 3]
    lengths = draw.integers(1, max(capacities) + 1, 300)
    if seed > 4:
        lengths[:200] = 7
    rows = [(i, int(n)) for i, n in enumerate(lengths)]
    found = best_fit(spark.createDataFrame(rows, "doc_id long, n_tokens long"), capacities).collect()
    bins = {}
    for row in sorted(found, key=lambda r: r["offset"]):
        at, capacity, total = bins.setdefault(row["bin"], ([], row["capacity"], row["bin_tokens"]))
        assert row["offset"] == sum(at) and row["capacity"] == capacity
        at.append(row["n_tokens"])
        assert row["bin_tokens"] == total
    assert all(sum(at) == total for at, _, total in bins.values())
    assert sorted((tuple(at), capacity) for at, capacity, _ in bins.values()) == one_by_one(lengths, capacities)


def test_every_token_of_the_table_is_placed_once(documents, texts):
    rows = best_fit(token_counts(documents), (512, 1024)).collect()
    placed, bins = {}, {}
    for row in rows:
        placed.setdefault(row["doc_id"], []).append((row["start"], row["n_tokens"]))
        bins.setdefault((row["bin"], row["capacity"]), []).append((row["offset"], row["n_tokens"]))
    for doc, text in texts.items():
        at = 0
        for start, number in sorted(placed[doc]):
            assert start == at
            at += number
        assert at == len(words_of(text)) + 1
    for (_, capacity), parts in bins.items():
        at = 0
        for offset, number in sorted(parts):
            assert offset == at
            at += number
        assert at <= capacity


def test_few_pieces_do_not_open_the_largest_bin():
    plan = plan_bins({10: 1}, (16, 1024))
    assert plan.bins == [(0, 10, 16)]
    assert plan_bins({}, (16,)).count == 0


def test_odd_rows_and_empty(spark, odd, nothing):
    counts = token_counts(odd)
    assert counts.count() == odd.count()
    rows = best_fit(counts).collect()
    assert sum(row["n_tokens"] for row in rows) == counts.groupBy().sum("n_tokens").first()[0]
    assert best_fit(token_counts(nothing)).count() == 0
    frame = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 5)], "doc_id long, n_tokens long")
    assert [row["doc_id"] for row in best_fit(frame).collect()] == [4]
