"""Rates, similarity means, pass@k and the stage funnel.

Every aggregate here is by a handful of optimisation levels or by (task, level)
and combines before its shuffle, so one level or task holding most of the rows
costs one row per input task on the wire.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.passk import pass_at_k
from millrace.operators.ordered import id_bucket, with_positions

# The closed list of optimisation levels.
OPT_LEVELS = ("O0", "O1", "O2", "O3")


def opt_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(level,) for level in OPT_LEVELS], "opts string")


def on_opt_levels(aggregated: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """One row per optimisation level, ``default`` where a level has no rows.

    ``aggregated`` has one row per level, so both sides are four rows.
    """
    levels = opt_levels(aggregated.sparkSession)
    joined = levels.join(F.broadcast(aggregated.filter(F.col("opts").isin(*OPT_LEVELS))), "opts", "left")
    return joined.select("opts", *[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in columns])


def fixed_denominator_rates(verdicts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Compile and run rate per level over a quarter of the task rows.

    ``tasks`` has one row per task and level; the quarter is truncated to an
    integer and used for every level alike.
    """
    per_level = tasks.groupBy("opts").agg(F.count(F.lit(1)).alias("task_rows"))
    sums = verdicts.groupBy("opts").agg(
        F.sum("flag_compile").alias("compiled"), F.sum("flag_run").alias("ran")
    )
    # Four rows: the window without keys adds them up.
    everything = Window.partitionBy(F.lit(0))
    quarter = F.floor(F.sum("task_rows").over(everything) / 4)
    return (
        on_opt_levels(sums.join(per_level, "opts", "full"), ["compiled", "ran", "task_rows"], 0)
        .withColumn("denominator", quarter)
        .select(
            "opts",
            F.try_divide(F.col("compiled"), F.col("denominator")).alias("compile_rate"),
            F.try_divide(F.col("ran"), F.col("denominator")).alias("run_rate"),
        )
    )


def evaluated_rates(verdicts: DataFrame) -> DataFrame:
    """Counts and rates per level over the rows evaluated at that level.

    A level without rows has null rates.
    """
    sums = verdicts.groupBy("opts").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.sum("flag_compile").alias("compile_success"),
        F.sum("flag_run").alias("run_success"),
    )
    return on_opt_levels(sums, ["evaluated", "compile_success", "run_success"], 0).select(
        "opts",
        F.col("evaluated").cast("bigint").alias("evaluated"),
        F.col("compile_success").cast("bigint").alias("compile_success"),
        F.try_divide("compile_success", "evaluated").alias("compile_rate"),
        F.col("run_success").cast("bigint").alias("run_success"),
        F.try_divide("run_success", "evaluated").alias("run_rate"),
    )


def mean_similarity(scored: DataFrame, similarity: str = "similarity", drop_zero: bool = False) -> DataFrame:
    """Mean similarity per level, 0.0 for a level without rows.

    One suite keeps zero similarities in the mean and the other drops them.
    """
    value = F.col(similarity)
    if drop_zero:
        value = F.when(value != 0, value)
    means = scored.groupBy("opts").agg(F.avg(value).alias("mean_similarity"))
    return on_opt_levels(means, ["mean_similarity"])


def correct_counts(verdicts: DataFrame, flag: str = "flag_run") -> DataFrame:
    """Samples ``n`` and correct samples ``c`` per task and level."""
    return verdicts.groupBy("task_id", "opts").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("bigint")).alias("c")
    )


def task_pass_at_k(verdicts: DataFrame, ks: Sequence[int] = (1, 10)) -> DataFrame:
    counts = correct_counts(verdicts)
    return counts.select("*", *[pass_at_k("n", "c", k).alias(f"pass_at_{k}") for k in ks])


def mean_pass_at_k(verdicts: DataFrame, ks: Sequence[int] = (1, 10)) -> DataFrame:
    """Mean pass@k per level over its tasks, on all four levels."""
    names = [f"pass_at_{k}" for k in ks]
    means = task_pass_at_k(verdicts, ks).groupBy("opts").agg(*[F.avg(n).alias(n) for n in names])
    return on_opt_levels(means, names)


def stage_funnel(verdicts: DataFrame) -> DataFrame:
    """Rows passing each stage, per level.

    Flags are ``bare_compile`` (the function alone), ``has_target`` (a function
    was found in the text), ``deps_compile`` (with its dependencies), ``linked``,
    ``ran`` and ``equal``. Compiling counts if either attempt passes; every later
    stage needs the one before it.
    """

    def flag(name: str) -> Column:
        return F.col(name).cast("boolean")

    with_deps = flag("has_target") & flag("deps_compile")
    linked = with_deps & flag("linked")
    ran = linked & flag("ran")
    right = ran & flag("equal")
    sums = verdicts.groupBy("opts").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if(flag("bare_compile") | with_deps).alias("compiled"),
        F.count_if(linked).alias("linked"),
        F.count_if(ran).alias("ran"),
        F.count_if(right).alias("correct"),
    )
    return on_opt_levels(sums, ["evaluated", "compiled", "linked", "ran", "correct"], 0).select(
        "opts",
        *[F.col(c).cast("bigint").alias(c) for c in ("evaluated", "compiled", "linked", "ran", "correct")],
    )


def success_list(
    verdicts: DataFrame, flag: str, order: str, item: str, chunk: int = 1000, per_level: bool = True
) -> DataFrame:
    """Ordered success ids, as runs of at most ``chunk`` ids.

    A level's list can hold most of the data, so it is kept as numbered runs
    whose concatenation in ``chunk`` order is the list; no task sees it whole.
    ``order`` is the integer position of the evaluated row.
    """
    keys = ["opts"] if per_level else []
    passed = verdicts.filter(F.col(flag) == 1).select(*keys, order, F.col(item).alias("item"))
    numbered = with_positions(passed, keys, [order], id_bucket(order), "pos")
    ordered = F.sort_array(F.collect_list(F.struct("pos", "item")))
    return (
        numbered.withColumn("chunk", F.floor(F.col("pos") / chunk))
        .groupBy(*keys, "chunk")
        .agg(F.transform(ordered, lambda entry: entry["item"]).alias("items"))
    )
