"""Leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.scoring import OPT_LEVELS


def leaderboard(
    rows: DataFrame, metrics: Sequence[str], model: str = "model", bits: str = "mode"
) -> DataFrame:
    """Percentages per metric, bit width and model: one column per level, their
    mean as ``AVG``, and ``best_*`` marking the best of each column.

    ``metrics`` are 0/1 or 0..1 columns of ``rows``. The window only sees the
    aggregate, one row per metric, width and model.
    """
    levels = rows.groupBy(bits, model).pivot("opts", list(OPT_LEVELS)).agg(
        *[F.avg(metric).alias(metric) for metric in metrics], F.count(F.lit(1)).alias("rows")
    )
    percent = [
        F.struct(
            F.lit(metric).alias("metric"),
            *[(F.col(f"{level}_{metric}") * 100).alias(level) for level in OPT_LEVELS],
        )
        for metric in metrics
    ]
    long = levels.select(bits, model, F.inline(F.array(*percent)))
    present = F.filter(F.array(*OPT_LEVELS), lambda value: value.isNotNull())
    mean = F.aggregate(present, F.lit(0.0), lambda acc, value: acc + value) / F.size(present)
    columns = (*OPT_LEVELS, "AVG")
    exact = long.withColumn("AVG", mean)
    scored = exact.withColumns({column: F.round(column, 4) for column in columns})
    rivals = Window.partitionBy("metric", bits)
    return scored.select(
        "*",
        *[
            (F.col(c).isNotNull() & (F.rank().over(rivals.orderBy(F.col(c).desc_nulls_last())) == 1)).alias(f"best_{c}")
            for c in columns
        ],
    )
