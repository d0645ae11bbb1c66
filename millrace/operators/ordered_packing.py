"""Greedy packing of rows in the order they come in.

The same rules as ``packing``, for orders other than ascending length, where a
row's place hangs on all rows before it. What one stretch of rows does to a
buffer is a function of how full the buffer is when it begins: it yields how full
it is at the end and how many buffers were closed. Such functions are small, at
most one step for each row that can be the first to close a buffer, and they
compose. So each chunk of rows becomes its function, functions are composed in
groups, level by level, until a unit has one; then the fill with which each chunk
begins is read back down, and every chunk places its own rows. Bins never cross a
buffer, and a buffer is bounded, so they are laid out buffer by buffer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import whole, with_range_bucket
from millrace.operators.packing import BUFFER_FACTOR, BUFFERS_TOGETHER, UNIT
from millrace.session import cut_lineage

TOGETHER = 64


@dataclass
class Fill:
    """What some rows do to a buffer: ``total`` tokens, and steps by the entering fill.

    From ``start[k]`` on, up to the next, the fill at the end is ``end[k]`` after
    ``closed[k]`` closed buffers; below ``start[0]`` no buffer closes.
    """

    total: int
    start: np.ndarray
    end: np.ndarray
    closed: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray, capacity: int) -> Fill:
        so_far = np.concatenate([[0], np.cumsum(lengths)])
        # The rows that can close a buffer first: less than a buffer lies before them.
        place = np.arange(1, int(np.searchsorted(so_far, capacity, "left")) + 1)
        place = place[place < len(so_far)][::-1]
        start = np.maximum(capacity - so_far[place], 0)
        closed = np.ones(len(place), np.int64)
        going = np.arange(len(place))
        while len(going):
            following = np.searchsorted(so_far, so_far[place[going]] + capacity, "left")
            inside = following < len(so_far)
            going = going[inside]
            place[going] = following[inside]
            closed[going] += 1
        return cls(int(so_far[-1]), start, so_far[-1] - so_far[place], closed)

    def after(self, fill: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fill at the end and closed buffers for entering fills."""
        step = np.searchsorted(self.start, fill, "right") - 1
        if not len(self.start):
            return fill + self.total, np.zeros_like(fill)
        closes = step >= 0
        return np.where(closes, self.end[step], fill + self.total), np.where(closes, self.closed[step], 0)

    def then(self, other: Fill, capacity: int) -> Fill:
        """These rows, then those of ``other``."""
        end, closed = other.after(self.end)
        # Where these close none, the other's steps begin earlier by what these add.
        first = int(self.start[0]) if len(self.start) else capacity
        shifted = other.start - self.total
        kept = np.append(shifted[1:] > 0, True)[: len(shifted)] & (np.maximum(shifted, 0) < first)
        return Fill(
            self.total + other.total,
            np.concatenate([np.maximum(shifted[kept], 0), self.start]),
            np.concatenate([other.end[kept], end]),
            np.concatenate([other.closed[kept], self.closed + closed]),
        )


FILL = "total bigint, start array<bigint>, end array<bigint>, closed array<bigint>"


def _columns(fills: list[Fill]) -> dict[str, pa.Array]:
    lists = {name: pa.array([getattr(f, name) for f in fills], pa.list_(pa.int64())) for name in ("start", "end", "closed")}
    return {"total": pa.array([f.total for f in fills], pa.int64()), **lists}


def _fill(row: dict) -> Fill:
    return Fill(row["total"], *(np.array(row[name], np.int64) for name in ("start", "end", "closed")))


def _keyed(keys: Sequence[str], types: dict[str, str]) -> str:
    return ", ".join(f"{key} {types[key]}" for key in keys)


def _taken(rows: pa.Table, names: Sequence[str], count: int) -> dict[str, pa.Array]:
    """The first ``count`` rows of ``names``."""
    return {name: rows[name].slice(0, count) for name in names}


def _chunk_starts(chunks: DataFrame, capacity: int, unit: list[str], together: int) -> DataFrame:
    """``fill`` and ``buffer`` with which each chunk of ``chunks`` (unit, chunk and a function) begins."""
    types = dict(chunks.dtypes)

    def compose(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        whole_fill = None
        for row in rows.select(["total", "start", "end", "closed"]).to_pylist():
            whole_fill = _fill(row) if whole_fill is None else whole_fill.then(_fill(row), capacity)
        return pa.table({**_taken(rows, unit, 1), "chunk": rows["_group"].slice(0, 1), **_columns([whole_fill])})

    schema = f"{_keyed(unit, types)}, chunk bigint, {FILL}"
    grouped = chunks.withColumn("_group", whole(F.col("chunk"), F.lit(together)))
    levels = [grouped]
    while not grouped.filter("_group > 0").isEmpty():
        above = cut_lineage(grouped.groupBy(*unit, "_group").applyInArrow(compose, schema), "fills")
        grouped = above.withColumn("_group", whole(F.col("chunk"), F.lit(together)))
        levels.append(grouped)

    def descend(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        fill, buffer, starts = rows["_fill"][0].as_py(), rows["_buffer"][0].as_py(), []
        for row in rows.select(["total", "start", "end", "closed"]).to_pylist():
            starts.append((fill, buffer))
            end, closed = _fill(row).after(np.array([fill]))
            fill, buffer = int(end[0]), buffer + int(closed[0])
        found = {"fill": pa.array([s[0] for s in starts], pa.int64()), "buffer": pa.array([s[1] for s in starts], pa.int64())}
        return pa.table({**_taken(rows, [*unit, "chunk"], len(rows)), **found})

    starts = None
    for level in reversed(levels):
        if starts is None:
            asked = level.withColumn("_fill", F.lit(0).cast("bigint")).withColumn("_buffer", F.lit(0).cast("bigint"))
        else:
            above = starts.select(*unit, F.col("chunk").alias("_group"), F.col("fill").alias("_fill"), F.col("buffer").alias("_buffer"))
            asked = level.join(above, [*unit, "_group"])
        found = f"{_keyed(unit, types)}, chunk bigint, fill bigint, buffer bigint"
        starts = cut_lineage(asked.groupBy(*unit, "_group").applyInArrow(descend, found), "fill-starts")
    return starts


def buffer_numbers(lengths: np.ndarray, fill: int, buffer: int, capacity: int) -> np.ndarray:
    """Buffer of each row of a chunk that begins in ``buffer`` with ``fill`` tokens."""
    so_far = np.cumsum(lengths)
    numbers, first, before = np.empty(len(lengths), np.int64), 0, -fill
    while first < len(lengths):
        last = int(np.searchsorted(so_far, before + capacity, "left"))
        numbers[first : last + 1] = buffer
        if last >= len(lengths):
            break
        first, before, buffer = last + 1, so_far[last], buffer + 1
    return numbers


def bins_in_order(lengths: np.ndarray, max_length: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in it and whether it is left open, for the rows of one buffer."""
    alone = lengths > max_length
    fitting = np.flatnonzero(~alone)
    so_far = np.concatenate([[0], np.cumsum(lengths[fitting])])
    opens = np.zeros(len(fitting), bool)
    pos = np.zeros(len(lengths), np.int64)
    at = 0
    while at < len(fitting):
        opens[at] = True
        following = int(np.searchsorted(so_far, so_far[at] + max_length, "right")) - 1
        pos[fitting[at:following]] = np.arange(following - at)
        last, at = at, following
    # Bins are numbered as they open, those of a single long row among them.
    opening = alone.copy()
    opening[fitting] = opens
    numbers = np.cumsum(opening) - 1
    bins = numbers.copy()
    bins[fitting] = numbers[fitting[np.flatnonzero(opens)]][np.cumsum(opens) - 1]
    residual = np.zeros(len(lengths), bool)
    if len(fitting) and lengths.sum() >= capacity:
        residual[fitting[last:]] = True
    return bins, pos, residual


def plan_in_order(
    lengths: DataFrame,
    max_length: int,
    buffer_factor: int = BUFFER_FACTOR,
    unit: Sequence[str] = UNIT,
    row_id: str = "row_id",
    buffers_together: int = BUFFERS_TOGETHER,
    together: int = TOGETHER,
) -> DataFrame:
    """Place every row in the order of ``row_id``: add ``buffer``, ``bin``, ``pos`` and ``residual``.

    As ``plan_packing``, but rows keep their order. ``lengths`` has the unit
    columns, a ``row_id`` unique in its unit and of any sortable type, and
    ``seq_length`` of at least 1. Rows are stored in ranges of their order; a
    range of a unit is a chunk, so one unit with all rows is as many tasks as
    there are ranges. No task holds more than a range, ``together`` functions, or
    ``buffers_together`` buffers. An empty table gives an empty result.
    """
    unit, capacity = list(unit), max_length * buffer_factor
    types = dict(lengths.dtypes)
    slim = lengths.select(*unit, row_id, "seq_length")
    stored = with_range_bucket(slim, *unit, row_id, bucket="_range")
    stored = stored.withColumn("chunk", F.col("_range").cast("bigint")).drop("_range")

    def measure(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(row_id)
        fill = Fill.of(rows["seq_length"].to_numpy().astype(np.int64), capacity)
        return pa.table({**_taken(rows, [*unit, "chunk"], 1), **_columns([fill])})

    chunks = stored.groupBy(*unit, "chunk").applyInArrow(measure, f"{_keyed(unit, types)}, chunk bigint, {FILL}")
    starts = _chunk_starts(cut_lineage(chunks, "chunk-fills"), capacity, unit, together)

    def deal(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(row_id)
        numbers = buffer_numbers(
            rows["seq_length"].to_numpy().astype(np.int64), rows["fill"][0].as_py(), rows["buffer"][0].as_py(), capacity
        )
        return pa.table({**_taken(rows, [*unit, row_id, "seq_length"], len(rows)), "buffer": pa.array(numbers)})

    dealt_schema = f"{_keyed([*unit, row_id, 'seq_length'], types)}, buffer bigint"
    dealt = stored.join(starts, [*unit, "chunk"]).groupBy(*unit, "chunk").applyInArrow(deal, dealt_schema)

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("buffer", "ascending"), (row_id, "ascending")])
        sizes, buffers = rows["seq_length"].to_numpy().astype(np.int64), rows["buffer"].to_numpy()
        bounds = np.flatnonzero(np.diff(buffers, prepend=-1, append=-1))
        parts = [bins_in_order(sizes[a:b], max_length, capacity) for a, b in zip(bounds, bounds[1:], strict=False)]
        bins, pos, residual = (np.concatenate(values) for values in zip(*parts, strict=True))
        placed = {"bin": pa.array(bins), "pos": pa.array(pos), "residual": pa.array(residual)}
        return pa.table({**_taken(rows, [*unit, row_id, "seq_length", "buffer"], len(rows)), **placed})

    grouped = dealt.withColumn("_together", whole(F.col("buffer"), F.lit(buffers_together))).groupBy(*unit, "_together")
    plan = grouped.applyInArrow(place, f"{dealt_schema}, bin bigint, pos bigint, residual boolean")
    if set(lengths.columns) == {*unit, row_id, "seq_length"}:
        return plan.select(*lengths.columns, "buffer", "bin", "pos", "residual")
    rest = lengths.join(plan.drop("seq_length"), [*unit, row_id])
    return rest.select(*lengths.columns, "buffer", "bin", "pos", "residual")
