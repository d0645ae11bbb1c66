"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    joined = links.join(least, "b")
    own = joined.select(F.col("m").alias("a"), "b")
    others = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.union(others).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def component_labels(links: DataFrame) -> DataFrame:
    """node and label, the least node reachable, for every node of ``links`` (a, b).

    The links are replaced by stars around ever smaller nodes until nothing
    changes; the number of rounds grows with the logarithm of the longest path.
    No component is gathered in one place, and hot centres are only aggregated.
    """
    current = cut_lineage(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    state = _state(current)
    while state[0]:
        current = cut_lineage(_small_star(_large_star(current)), "stars")
        previous, state = state, _state(current)
        if state == previous:
            break
    return current.select(F.col("b").alias("node"), F.col("a").alias("label")).union(
        current.select("a", "a").distinct()
    )
