"""Joins between tasks, results and reference data. All are equi-joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(value: Column, message: str) -> Column:
    """``value``, or an error naming the missing piece when the row is used."""
    return F.when(value.isNull(), F.raise_error(F.lit(message))).otherwise(value)


def join_results(
    tasks: DataFrame,
    results: DataFrame,
    keys: Sequence[str] = ("task_id", "opts"),
    value: str = "gen",
    on_missing: str = "error",
) -> DataFrame:
    """Tasks with their one result per key (see ``last_write``).

    A task without a result is an error; ``skip`` leaves it out and ``flag``
    keeps it with ``missing`` set, to be reported.
    """
    picked = results.select(*keys, value)
    if on_missing == "skip":
        return tasks.join(picked, list(keys))
    joined = tasks.join(picked, list(keys), "left")
    if on_missing == "flag":
        return joined.withColumn("missing", F.col(value).isNull())
    if on_missing != "error":
        raise ValueError("on_missing is 'error', 'skip' or 'flag'")
    return joined.withColumn(value, require(F.col(value), f"task without {value}"))


def with_samples(tasks: DataFrame, samples: int = 20, column: str = "sample") -> DataFrame:
    """One row per task and sample index; ``samples`` is a fixed parameter."""
    return tasks.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def attach(
    names: DataFrame,
    parts: Mapping[str, DataFrame],
    key: str = "func",
    on_missing: str = "error",
) -> DataFrame:
    """Left-join one text per entity from each of ``parts`` (column name to table)."""
    joined = names
    for column, table in parts.items():
        joined = joined.join(table.select(key, column), key, "left")
    if on_missing == "flag":
        gaps = [F.when(F.col(c).isNull(), F.lit(c)) for c in parts]
        return joined.withColumn("missing", F.concat_ws(",", *gaps))
    if on_missing != "error":
        raise ValueError("on_missing is 'error' or 'flag'")
    for column in parts:
        joined = joined.withColumn(column, require(F.col(column), f"{column} not found"))
    return joined


def with_generated(names: DataFrame, generated: DataFrame, key: str = "func") -> DataFrame:
    """Entities that have generated text; the others are skipped."""
    return names.join(generated, key)


def members_only(rows: DataFrame, members: DataFrame, keys: Sequence[str] = ("func", "mode", "opts")) -> DataFrame:
    """Rows whose key is on a membership list; the optimizer sizes the list side."""
    return rows.join(members.select(*keys), list(keys), "left_semi")


def not_done(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a stored answer."""
    return rows.join(done.select(*keys), list(keys), "left_anti")
