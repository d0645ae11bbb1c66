import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import permutation as pm


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5), st.integers(0, 3))
def test_every_place_once_and_back(count, seed, epoch):
    keys = pm.round_keys(seed, epoch)
    numbers = np.arange(count)
    placed = pm.permuted(numbers, count, keys)
    assert np.array_equal(np.sort(placed), numbers)
    assert np.array_equal(pm.permuted(placed, count, keys, inverse=True), numbers)


@given(st.sampled_from([1, 2, 3, 10**6, (1 << 31) + 5, 10**15 + 7, pm.MOST]))
@settings(deadline=None)
def test_large_counts_go_there_and_back(count):
    numbers = np.unique(np.concatenate([np.arange(min(count, 50)), count - 1 - np.arange(min(count, 50))]))
    keys = pm.round_keys(1, 0)
    placed = pm.permuted(numbers, count, keys)
    assert len(np.unique(placed)) == len(numbers) and placed.min() >= 0 and placed.max() < count
    assert np.array_equal(pm.permuted(placed, count, keys, inverse=True), numbers)


def test_places_look_drawn():
    count = 40_000
    orders = [pm.permuted(np.arange(count), count, pm.round_keys(7, epoch)) for epoch in range(2)]
    for order in orders:
        assert abs(np.corrcoef(order, np.arange(count))[0, 1]) < 0.03
        assert abs(np.corrcoef(order[:-1], order[1:])[0, 1]) < 0.03
        halves = (order < count // 2).reshape(200, 200).sum(axis=1)
        assert 60 < halves.min() and halves.max() < 140
    assert abs(np.corrcoef(*orders)[0, 1]) < 0.03 and (orders[0] == orders[1]).sum() < 20


@pytest.mark.parametrize("drop_last", [False, True])
@pytest.mark.parametrize("count", [1, 5, 7, 100])
def test_shards_of_all_ranks(spark, count, drop_last):
    rows = spark.range(count).withColumnRenamed("id", "row_number").repartition(3)
    found = pm.permuted_shards(rows, count, 7, 2, seed=3, drop_last=drop_last).collect()
    rounds = count // 7 if drop_last else -(-count // 7)
    for epoch in range(2):
        own = [r for r in found if r["epoch"] == epoch]
        assert sorted((r["rank"], r["rank_pos"]) for r in own) == [(rank, at) for rank in range(7) for at in range(rounds)]
        order = pm.permuted(np.arange(count), count, pm.round_keys(3, epoch)).tolist()
        assert all((r["rank_pos"] * 7 + r["rank"]) % count == order[r["row_number"]] for r in own)
        assert all(r["rank_rows"] == rounds for r in own)


def test_an_epoch_has_no_exchange(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_number")
    plan = pm.permuted_shards(rows, 1000, 4, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_resumed_rank_reads_what_is_left(spark):
    rows = spark.range(103).withColumnRenamed("id", "row_number")
    whole = pm.permuted_shards(rows, 103, 4, 1, seed=5).filter("rank = 2 and rank_pos >= 9").select("rank_pos", "row_number")
    left = pm.numbers_left(spark, 103, 4, 2, 0, seed=5, start_index=9)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, left.collect()))


def test_odd_rows(spark):
    frame = spark.createDataFrame([(0,), (None,), (1,)], "row_number long")
    assert {r["row_number"] for r in pm.permuted_shards(frame, 2, 1, 1).collect()} == {0, 1}
    assert pm.permuted_shards(frame.limit(0), 0, 3, 2).count() == 0
    with pytest.raises(Exception, match="not from 0 to 0"):
        pm.permuted_shards(frame, 1, 1, 1).collect()
    with pytest.raises(ValueError):
        pm.permuted_shards(frame, 1, 0, 1)
