"""Last write wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep, per key, the row that comes last in ``order``.

    A ``max_by`` aggregate combines before the shuffle, so a key with many
    versions ships one row per task; a window would ship all of them.
    """
    rest = [name for name in df.columns if name not in keys]
    winner = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(winner).select(*keys, "_last.*").select(*df.columns)
