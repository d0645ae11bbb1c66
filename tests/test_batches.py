import math

import pytest
from pyspark.sql import functions as F

from millrace.operators import batches, sharding


def rows_of(spark, n):
    return batches.with_epochs(spark.range(n).withColumnRenamed("id", "row_id"), 1)


@pytest.mark.parametrize("n, ranks, drop_last, start", [(10, 4, False, 0), (10, 4, True, 0), (3, 8, False, 0), (8, 4, False, 1), (29, 5, False, 2)])
def test_rank_shards(spark, n, ranks, drop_last, start):
    out = batches.rank_shards(rows_of(spark, n), ranks, shuffle=False, drop_last=drop_last, start_index=start).collect()
    rounds = n // ranks if drop_last else math.ceil(n / ranks)
    order = list(range(n))
    while len(order) < rounds * ranks:
        order += list(range(n))
    order = order[: rounds * ranks]
    for rank in range(ranks):
        mine = [r.row_id for r in sorted((r for r in out if r.rank == rank), key=lambda r: r.rank_pos)]
        assert mine == order[rank::ranks][start:]
        assert all(r.rank_rows == len(mine) for r in out if r.rank == rank)


def test_shuffle_repeats_and_changes_with_epoch(spark):
    rows = batches.with_epochs(spark.range(50).withColumnRenamed("id", "row_id"), 2)
    first = batches.rank_shards(rows, 1, seed=3).orderBy("epoch", "rank_pos").collect()
    again = batches.rank_shards(rows, 1, seed=3).orderBy("epoch", "rank_pos").collect()
    assert first == again
    orders = [[r.row_id for r in first if r.epoch == e] for e in (0, 1)]
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(50)) and orders[0] != orders[1]
    # Seed plus epoch decides: seed 4 starts where seed 3 has its second epoch.
    shifted = batches.rank_shards(rows_of(spark, 50), 1, seed=4).orderBy("rank_pos").collect()
    assert [r.row_id for r in shifted] == orders[1]


def test_full_batches_only(spark):
    sharded = batches.rank_shards(rows_of(spark, 23), 2)
    kept = batches.with_batches(sharded, 5).groupBy("rank", "batch").count().collect()
    assert all(r["count"] == 5 for r in kept) and len(kept) == 4
    assert batches.with_batches(sharded, 5, drop_last=False).count() == 24


def test_padding(spark):
    rows = [(0, 0, 0, [5, 9, 9], [5, 9, 9]), (0, 0, 0, [1], [-100]), (0, 0, 1, [1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 6])]
    frame = spark.createDataFrame(rows, "epoch int, rank int, batch int, input_ids array<int>, labels array<int>")
    right = [r for r in batches.pad(frame, 9, 4).collect()]
    assert right[0].input_ids == [5, 9, 9, 9] and right[0].attention_mask == [True, False, False, False]
    assert right[1].labels == [-100, -100, -100, -100] and right[2].input_ids == [1, 2, 3, 4]
    left = {tuple(r.input_ids) for r in batches.pad(frame, 9, 4, side="left").collect()}
    assert left == {(5, 9, 9), (9, 9, 1), (1, 2, 3, 4)}
    longest = {tuple(r.input_ids) for r in batches.pad(frame, 9, 4, padding="longest").collect()}
    assert longest == {(5, 9, 9), (1, 9, 9), (1, 2, 3, 4)}
    with pytest.raises(ValueError):
        batches.pad(frame, -1)


@pytest.mark.parametrize("files, parts, sizes", [(10, 4, [3, 3, 3, 1]), (5, 4, [2, 2, 1])])
def test_folder_parts(spark, files, parts, sizes):
    frame = spark.range(files).select(F.lit("a").alias("folder"), F.col("id").alias("file_id"))
    out = sharding.assign_parts(frame, parts).orderBy("file_id").collect()
    assert [r.part for r in out] == [p for p, n in enumerate(sizes) for _ in range(n)]


def test_slices(spark):
    assert sharding.slice_starts(4) == [0, 25, 50, 75] and sharding.slice_starts(3) == [0, 34, 68]
    assert len(sharding.slice_starts(60)) == 50
    with pytest.raises(ValueError):
        sharding.slice_starts(100000)
    frame = spark.range(10).select(F.lit(0).alias("part"), F.col("id").alias("row_id"))
    out = sharding.assign_slices(frame, 4).orderBy("row_id").collect()
    # Boundaries 2.5, 5 and 7.5 round to 2, 5 and 8.
    assert [r.split for r in out] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]


def test_overwritten_files(spark):
    frame = spark.createDataFrame([("a", "x", 0), ("b", "x", 0), ("b", "y", 0), ("a", "y", 1)], "folder string, file_name string, part int")
    merged = sharding.merge_parts(frame.filter("folder = 'a'"), frame.filter("folder = 'b'"))
    assert merged.count() == 4
    assert [(r.part, r.file_name, r.copies, r.last_folder) for r in sharding.overwritten_files(merged).collect()] == [(0, "x", 2, "b")]


def test_resume_reads_later_epochs_whole(spark):
    rows = batches.with_epochs(spark.range(8).withColumnRenamed("id", "row_id"), 3)
    out = batches.rank_shards(rows, 2, start_index=3, resume_epoch=1).collect()
    assert sorted({row.epoch for row in out}) == [1, 2]
    assert sum(row.epoch == 1 for row in out) == 2 and {row.row_id for row in out if row.epoch == 2} == set(range(8))
    assert {(row.epoch, row.rank_rows) for row in out} == {(1, 1), (2, 4)}
