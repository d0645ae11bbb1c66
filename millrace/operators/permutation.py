"""Epoch orders by arithmetic: a keyed permutation of the row numbers.

Rows are numbered once, from 0 to ``count`` - 1; the number is stored with them.
The place of a row in an epoch is then a function of its number, the seed and the
epoch, so no epoch is sorted or shuffled, and the rows at given places, such as
all that a resumed run has left, are found by the inverse.

The function is a Feistel network on a rectangle of just over ``count`` cells. A
number that lands outside is sent through again until it is inside, which keeps
it a permutation.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function

ROUNDS = 8
# Squares of remainders stay below 2**62.
PRIME = (1 << 31) - 1
MOST = 1 << 60


def round_keys(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Factor and two summands of each round's mixing function."""
    keys = []
    for turn in range(ROUNDS):
        digest = hashlib.sha256(f"{seed}:{epoch}:{turn}".encode()).digest()
        values = [int.from_bytes(digest[4 * i : 4 * i + 4], "big") % PRIME for i in range(3)]
        keys.append((max(1, values[0]), values[1], values[2]))
    return keys


def sides(count: int) -> tuple[int, int]:
    """Rows and columns of the rectangle."""
    if not 0 <= count <= MOST:
        raise ValueError(f"count is from 0 to {MOST}")
    rows = math.isqrt(max(0, count - 1)) + 1
    return rows, max(1, -(-count // rows))


def _mixed(side: np.ndarray, key: tuple[int, int, int]) -> np.ndarray:
    factor, first, second = key
    linear = (side % PRIME * factor + first) % PRIME
    return (linear * linear + second) % PRIME


def _network(values: np.ndarray, count: int, keys: list[tuple[int, int, int]], sign: int) -> np.ndarray:
    rows, columns = sides(count)
    left, right = values // columns, values % columns
    for turn in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
        if turn % 2:
            right = (right + sign * _mixed(left, keys[turn])) % columns
        else:
            left = (left + sign * _mixed(right, keys[turn])) % rows
    return left * columns + right


def permuted(values: np.ndarray, count: int, keys: list[tuple[int, int, int]], inverse: bool = False) -> np.ndarray:
    """The place of each number below ``count``, or with ``inverse`` the number at each place."""
    if len(values) and (values.min() < 0 or values.max() >= count):
        raise ValueError(f"a row number is not from 0 to {count - 1}")
    sign = -1 if inverse else 1
    placed = _network(values, count, keys, sign)
    outside = np.flatnonzero(placed >= count)
    while len(outside):
        placed[outside] = _network(placed[outside], count, keys, sign)
        outside = outside[placed[outside] >= count]
    return placed


def place_of(number: str | Column, count: int, seed: int, epoch: int, inverse: bool = False) -> Column:
    """``permuted`` over a column of row numbers; null stays null."""
    keys = round_keys(seed, epoch)

    def place(numbers: pa.Array) -> pa.Array:
        known = numbers.is_valid().to_numpy(zero_copy_only=False)
        values = numbers.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).copy()
        values[known] = permuted(values[known], count, keys, inverse)
        return pa.array(values, pa.int64(), mask=~known)

    return arrow_function(place, "bigint")(F.col(number) if isinstance(number, str) else number)


def rounds_of(count: int, ranks: int, drop_last: bool) -> int:
    """How many rows each rank has in an epoch."""
    return count // ranks if drop_last else -(-count // ranks)


def permuted_shards(
    rows: DataFrame,
    count: int,
    ranks: int,
    epochs: int,
    number: str = "row_number",
    seed: int = 0,
    drop_last: bool = False,
    start_index: int = 0,
    resume_epoch: int = 0,
) -> DataFrame:
    """``rank_shards`` for numbered rows: epoch, rank, rank_pos and rank_rows, by arithmetic on ``number``.

    ``number`` runs from 0 to ``count`` - 1 over ``rows``, each once; a number out
    of range is an error, a null one is left out. Places beyond the last row wrap
    to the first ones, or with ``drop_last`` an incomplete round is left out. The
    plan has no exchange. A resumed run has the rows at ``start_index`` and after
    in ``resume_epoch``, and later epochs whole.
    """
    if ranks < 1:
        raise ValueError("ranks is at least 1")
    rounds = rounds_of(count, ranks, drop_last)
    if count == 0 or epochs <= resume_epoch:
        shape = "*", "0 as epoch", "0 as rank", "0L as rank_pos", "0L as rank_rows"
        return rows.limit(0).selectExpr(*shape)
    # One scan for all epochs.
    places = [
        F.struct(F.lit(epoch).alias("epoch"), place_of(number, count, seed, epoch).alias("place"))
        for epoch in range(resume_epoch, epochs)
    ]
    dealt = rows.select("*", F.explode(F.array(*places)).alias("_at")).filter("_at.place is not null")
    last = F.lit(rounds * ranks - 1)
    places = F.when(F.col("_at.place") <= last, F.sequence(F.col("_at.place"), last, F.lit(count)))
    wrapped = dealt.select(*rows.columns, F.col("_at.epoch").alias("epoch"), F.explode(places).alias("_place"))
    start = F.when(F.col("epoch") == resume_epoch, start_index).otherwise(0)
    return (
        wrapped.withColumn("rank", F.pmod("_place", F.lit(ranks)).cast("int"))
        .withColumn("rank_pos", F.call_function("div", F.col("_place"), F.lit(ranks)) - start)
        .withColumn("rank_rows", F.greatest(F.lit(rounds) - start, F.lit(0)).cast("bigint"))
        .filter("rank_pos >= 0")
        .drop("_place")
    )


def numbers_left(spark, count: int, ranks: int, rank: int, epoch: int, seed: int = 0, start_index: int = 0) -> DataFrame:
    """rank_pos and row_number of what ``rank`` still reads in ``epoch`` from ``start_index`` on, in order.

    By the inverse, so what was read already is not looked at; joined with a table
    stored by row number it reads the rest only.
    """
    rounds = rounds_of(count, ranks, False)
    places = spark.range(start_index, rounds).select(F.col("id").alias("rank_pos"))
    place = F.pmod(F.col("rank_pos") * ranks + rank, F.lit(max(1, count)))
    return places.select("rank_pos", place_of(place, count, seed, epoch, inverse=True).alias("row_number"))
