"""pass@k."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: str | Column, c: str | Column, k: int) -> Column:
    """Chance that one of ``k`` draws from ``n`` samples, ``c`` correct, is correct.

    1 when fewer than ``k`` are wrong, else ``1 - prod(1 - k/i)`` for ``i`` from
    ``n - c + 1`` to ``n``.
    """
    n = F.col(n) if isinstance(n, str) else n
    c = F.col(c) if isinstance(c, str) else c
    all_wrong = F.aggregate(
        F.sequence(n - c + 1, n),
        F.lit(1.0),
        lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i),
    )
    return (
        F.when(n - c < k, F.lit(1.0))
        .when(c == 0, F.lit(0.0))
        .otherwise(F.lit(1.0) - all_wrong)
    )
