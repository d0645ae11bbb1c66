"""Splitting folders into parts and parts into percent slices."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import sketch_bucket, with_positions


def assign_parts(
    files: DataFrame,
    num_parts: int = 10,
    folder: str = "folder",
    order: str = "file_id",
    bucket: Column | None = None,
) -> DataFrame:
    """Contiguous runs of ``ceil(files / num_parts)`` files per folder, as ``part``.

    Late parts can be empty, unlike with ``ntile``.
    """
    numbered = with_positions(
        files, [folder], [order], bucket if bucket is not None else sketch_bucket(files, order), "_pos", count="_files"
    )
    per_part = F.ceil(F.col("_files") / num_parts)
    return numbered.withColumn("part", F.floor(F.col("_pos") / per_part).cast("int")).drop("_pos", "_files")


def merge_parts(*folders: DataFrame) -> DataFrame:
    """Same-numbered parts of all folders together.

    Rows keep their folder, so equal file names of two folders both stay;
    ``overwritten_files`` lists the names a merge by file name would have lost.
    """
    merged = folders[0]
    for other in folders[1:]:
        merged = merged.unionByName(other)
    return merged.withColumn("merged_folder", F.concat(F.lit("new_input_"), F.col("part").cast("string")))


def overwritten_files(merged: DataFrame, name: str = "file_name", folder: str = "folder") -> DataFrame:
    """File names that more than one folder has in the same part, and who would win."""
    return (
        merged.groupBy("part", name)
        .agg(F.count(F.lit(1)).alias("copies"), F.max(folder).alias("last_folder"))
        .filter(F.col("copies") > 1)
    )


def slice_starts(bins: int) -> list[int]:
    """Start percentages of the slices; steps of ``ceil(100 / bins)``."""
    if bins >= 100000:
        raise ValueError(f"bins is below 100000; got {bins}")
    return list(range(0, 100, math.ceil(100 / bins)))


def assign_slices(
    rows: DataFrame,
    bins: int = 4,
    part: str = "part",
    order: str | Sequence[str] = "row_id",
    bucket: Column | None = None,
    position: str | None = None,
) -> DataFrame:
    """Percent slice of each row in its part, as ``split``.

    A slice starts at its percentage of the part's rows, rounded half to even.
    ``position`` names a column for the row's place in its part.
    """
    columns = [order] if isinstance(order, str) else list(order)
    by = bucket if bucket is not None else sketch_bucket(rows, columns[0])
    numbered = with_positions(rows, [part], columns, by, "_pos", count="_rows")
    if position:
        numbered = numbered.withColumn(position, F.col("_pos"))
    starts = F.array(*[F.bround(F.col("_rows") * start / 100.0) for start in slice_starts(bins)])
    reached = F.filter(starts, lambda start: start <= F.col("_pos"))
    return numbered.withColumn("split", F.size(reached) - 1).drop("_pos", "_rows")


def concatenate(*shards: DataFrame) -> DataFrame:
    """All rows of the shards; columns are matched by name."""
    joined = shards[0]
    for shard in shards[1:]:
        joined = joined.unionByName(shard)
    return joined
