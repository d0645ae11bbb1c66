"""Row positions and running totals inside groups of any size.

``row_number() over (partition by key order by ...)`` puts a whole key in one
task. Here each key is cut into order-preserving buckets of bounded size: the
bucket sizes are a partial aggregate, their running sum gives every bucket its
offset, and the window that sorts rows only ever sees one bucket. A key that
holds a third of the data is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function
from millrace.session import cut_lineage

ID_BUCKET_ROWS = 1 << 20
# Above this many, buckets get larger than asked for; the sketch then holds ten times as many values.
MOST_BUCKETS = 1 << 13


def with_range_bucket(df: DataFrame, *order: str, bucket: str = "range_bucket") -> DataFrame:
    """``df`` stored in ``order``, with the number of each row's range as a bucket.

    For orders without a computable bucket, such as names. The ranges come from
    a sample, so the rows are written out: every later read sees the same ones.
    """
    ranged = df.repartitionByRange(*order).withColumn(bucket, F.spark_partition_id())
    return cut_lineage(ranged, "ranges")


def whole(left: Column, right: Column) -> Column:
    """Integer quotient, exact for any bigint."""
    return F.call_function("div", left, right)


def id_bucket(column: str | Column, width: int = ID_BUCKET_ROWS) -> Column:
    """Bucket of a unique integer id, in id order: ``width`` ids each, twice that at 0."""
    return whole(F.col(column) if isinstance(column, str) else column, F.lit(width))


def sketch_bucket(df: DataFrame, column: str, rows: int = ID_BUCKET_ROWS) -> Column:
    """Bucket of an integer column of ``df``, in its order, of about ``rows`` rows each however the values lie.

    Bounds come from a quantile sketch that tasks fill and merge, exact to a tenth
    of a bucket; ``with_positions`` then counts the buckets exactly. So ids that
    are hashes, sparse or in one dense cluster make as many buckets as there are
    rows for. Counts ``df`` and reads the column once more, so ``df`` should be
    cheap to read again. Only equal values cannot be parted; null stays null.
    """
    count = df.filter(F.col(column).isNotNull()).count()
    buckets = min(MOST_BUCKETS, -(-count // rows))
    if buckets <= 1:
        return F.when(F.col(column).isNotNull(), 0)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = np.unique(df.agg(F.percentile_approx(column, shares, 10 * buckets)).first()[0])

    def place(values: pa.Array) -> pa.Array:
        known = values.is_valid().to_numpy(zero_copy_only=False)
        places = np.searchsorted(bounds, values.fill_null(0).to_numpy(zero_copy_only=False), "left")
        return pa.array(places.astype(np.int32), pa.int32(), mask=~known)

    return arrow_function(place, "int")(F.col(column))


def digest_bucket(column: str | Column, digits: int = 4) -> Column:
    """Bucket of a hex digest: its leading digits, uniform and in digest order."""
    col = F.col(column) if isinstance(column, str) else column
    return F.substring(col, 1, digits)


def spread(scanned: DataFrame, *keys: str) -> DataFrame:
    """Rows of a scan over at least as many tasks as there are cores.

    For work whose cost is in the rows rather than in reading them. A scan of
    many files already has enough tasks and is returned as it is.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    if scanned.rdd.getNumPartitions() >= cores:
        return scanned
    return scanned.repartition(cores, *keys)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    position: str = "pos",
    running: Mapping[str, str] | None = None,
    count: str | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its key, in ``order``.

    ``bucket`` must not decrease along ``order`` and must split a key into
    bounded groups; a null key or bucket is an error. ``running`` maps a new column to a value column whose sum
    over the rows up to and including this one it holds; ``count`` names a
    column for the key's row count. The columns of ``per_key``, one row per key,
    are added too: they join the buckets, not the rows, so a hot key does not
    skew that join.
    """
    running = dict(running or {})
    sizes = (
        df.withColumn("_bucket", bucket)
        .groupBy(*keys, "_bucket")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.sum(value).alias(f"_sum_{name}") for name, value in running.items()],
        )
    )
    # One row per bucket here, so a key's window is about rows / bucket size.
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(key).alias(f"_of_{key}") for key in [*keys, "_bucket"]],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(before), F.lit(0)).alias(f"_before_{name}")
            for name in running
        ],
        *([F.sum("_rows").over(by_key).alias(count)] if count else []),
    )
    added = []
    if per_key is not None:
        added = [name for name in per_key.columns if name not in keys]
        renamed = per_key.select(*[F.col(key).alias(f"_of_{key}") for key in keys], *added)
        offsets = offsets.join(renamed, [f"_of_{key}" for key in keys], "left")
    # The window comes before the join, which then finds the rows partitioned
    # and sorted as it needs them.
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn("_bucket", bucket).select(
        *df.columns,
        "_bucket",
        (F.row_number().over(inside) - 1).alias("_in_bucket"),
        *[F.sum(value).over(upto).alias(f"_upto_{name}") for name, value in running.items()],
    )
    same = [F.col(key) == F.col(f"_of_{key}") for key in [*keys, "_bucket"]]
    placed = ranked.join(offsets, same, "left")
    start = F.when(F.col("_before").isNull(), F.raise_error(F.lit("null key or bucket"))).otherwise(F.col("_before"))
    return placed.select(
        *[F.col(name) for name in df.columns],
        (start + F.col("_in_bucket")).cast("bigint").alias(position),
        *[(F.col(f"_before_{name}") + F.col(f"_upto_{name}")).alias(name) for name in running],
        *([F.col(count)] if count else []),
        *added,
    )
