"""Edit similarity over characters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function

# Columns between two looks at what the distance can still become.
LOOK = 256
BLOCK = 1024


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def distance_of(left: str, right: str, limit: int | None = None) -> int:
    """Levenshtein distance, or ``limit`` if it is not below that.

    Bit-parallel: a whole column of the table is two numbers, with a bit for each
    character where the distance rises or falls by one, and a character of the
    other text is a few operations on them. Common ends are left out.
    """
    if left == right:
        return 0 if limit is None else min(0, limit)
    if len(left) < len(right):
        left, right = right, left
    start, most = 0, len(right)
    while start < most and left[start] == right[start]:
        start += 1
    end = 0
    while end < most - start and left[-1 - end] == right[-1 - end]:
        end += 1
    left, right = left[start : len(left) - end], right[start : len(right) - end]
    limit = len(left) if limit is None else min(limit, len(left))
    if not right or len(left) - len(right) >= limit:
        return limit
    places: dict[str, int] = {}
    for begin in range(0, len(right), BLOCK):
        # Bits are set in short numbers, which are then moved to their place in the long ones.
        block: dict[str, int] = {}
        for at, character in enumerate(right[begin : begin + BLOCK]):
            block[character] = block.get(character, 0) | 1 << at
        for character, bits in block.items():
            places[character] = places.get(character, 0) | bits << begin
    mask = (1 << len(right)) - 1
    rises, falls = mask, 0
    for at, character in enumerate(left, 1):
        here = places.get(character, 0)
        diagonal = ((((here & rises) + rises) ^ rises) | here | falls) & mask
        up = falls | (mask ^ (diagonal | rises))
        down = rises & diagonal
        up = up << 1 | 1
        rises = down << 1 & mask | (mask ^ ((diagonal | up) & mask))
        falls = up & diagonal
        if at % LOOK == 0:
            # Each character left can lower the distance by one at most.
            least = at + rises.bit_count() - falls.bit_count() - (len(left) - at)
            if least >= limit:
                return limit
    return min(limit, len(left) + rises.bit_count() - falls.bit_count())


def edit_distance(left: str | Column, right: str | Column, limit: str | Column | None = None) -> Column:
    """Levenshtein distance over code points; with ``limit`` the lesser of it and the distance. Null with a null text."""

    def measure(left: pa.Array, right: pa.Array, limit: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), limit.to_pylist(), strict=True)
        distances = [None if a is None or b is None else distance_of(a, b, most) for a, b, most in pairs]
        return pa.array(distances, pa.int32())

    most = F.lit(None) if limit is None else _col(limit)
    return arrow_function(measure, "int")(_col(left), _col(right), most.cast("int"))


def edit_similarity(
    left: str | Column, right: str | Column, divisor: str = "right", distance: str | Column | None = None
) -> Column:
    """``max(0, 1 - distance / length)``; 0.0 when the divisor text is empty.

    Metric runs pass the source as ``left`` and the generated text as ``right``,
    so the default divisor is the length of the generated text.

    A distance of the divisor or more gives 0.0, so it is measured up to there
    only. A ``distance`` column already at hand is used instead.
    """
    left, right = _col(left), _col(right)
    if divisor not in ("left", "right"):
        raise ValueError("divisor is 'left' or 'right'")
    size = F.length(right if divisor == "right" else left)
    measured = edit_distance(left, right, size) if distance is None else _col(distance)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - measured / size))
