"""Greedy packing of length-sorted rows into rows of at most ``max_length`` tokens.

Rows of a unit (part and split) are read in ascending length into buffers of
``buffer_factor * max_length`` tokens; inside a buffer a bin takes rows until the
next one would not fit. Read one by one this is a sequential fold over a unit.

Rows of equal length are interchangeable to it, so the fold runs over a
histogram instead: ``(length, count)`` pairs, at most one per distinct length
however many rows the unit has. A run of equal lengths finishes the open
buffer, then repeats one buffer layout, then opens the last: at most three
segments, each of which places its rows by arithmetic on their rank in the run.
Ranks come from ``with_positions``, which splits a hot length over many tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.tokenizers import ID_BYTES, joined_members
from millrace.operators.filters import IGNORE_INDEX, all_masked
from millrace.operators.ordered import id_bucket, whole, with_positions
from millrace.operators.tokens import masked_labels

UNIT = ("part", "split")
BUFFER_FACTOR = 16

# One segment: rows ``first <= rank < last`` of a run. With ``at = (rank - first)
# % period``, the row is in buffer ``buffer + (rank - first) // period``; the
# first ``room`` rows of a period join bin ``bin`` after ``members`` others and
# the rest fill new bins of ``fit`` rows, numbered on from ``after``. ``open_bin``
# is the bin still open when the buffer was full; it is -1 where no bin was, or
# the data ended first.
SEGMENT = (
    "first bigint, last bigint, period bigint, buffer bigint, bin bigint, after bigint, "
    "members bigint, room bigint, fit bigint, alone boolean, open_bin bigint"
)

ARROW_TYPES = {"bigint": pa.int64(), "boolean": pa.bool_()}
# 64 buffers of 16 * 4096 tokens, ids and labels, are about 32 MB.
BUFFERS_TOGETHER = 64


def layout(histogram: Sequence[tuple[int, int]], max_length: int, buffer_factor: int = BUFFER_FACTOR):
    """Segments of one unit from its ascending ``(length, count)`` pairs."""
    capacity = max_length * buffer_factor
    segments: list[dict] = []
    in_buffer: list[dict] = []
    buffer, held = 0, 0  # buffer number and its tokens
    current, used, members, opened = -1, 0, 0, 0  # open bin, its tokens and rows; bins opened

    def close():
        nonlocal buffer, held, current, used, members, opened, in_buffer
        for segment in in_buffer:
            segment["open_bin"] = current
        in_buffer = []
        buffer, held, current, used, members, opened = buffer + 1, 0, -1, 0, 0, 0

    for length, count in histogram:
        alone = length > max_length
        fit = 1 if alone else max_length // length
        per_buffer = -(-capacity // length)
        done = 0
        while done < count:
            segment = {"length": length, "first": done, "alone": alone, "fit": fit, "buffer": buffer, "open_bin": -1}
            if held == 0 and count - done >= per_buffer:
                repeats = (count - done) // per_buffer
                full = (per_buffer - 1) // fit
                segment |= {"last": done + repeats * per_buffer, "period": per_buffer}
                segment |= {"bin": -1, "after": -1, "members": 0, "room": 0}
                segment["open_bin"] = -1 if alone else full
                segments.append(segment)
                buffer += repeats
                done = segment["last"]
                continue
            taken = min(count - done, -(-(capacity - held) // length))
            room = 0 if alone or current < 0 else (max_length - used) // length
            segment |= {"last": done + taken, "period": taken}
            segment |= {"bin": current, "after": opened - 1, "members": members, "room": room}
            if alone:
                opened += taken
            elif taken <= room:
                used, members = used + taken * length, members + taken
            else:
                new_rows = taken - room
                new_bins = -(-new_rows // fit)
                current = opened + new_bins - 1
                opened += new_bins
                members = new_rows - (new_bins - 1) * fit
                used = members * length
            segments.append(segment)
            in_buffer.append(segment)
            held += taken * length
            done += taken
            if held >= capacity:
                close()
    return segments


def packing_segments(
    histogram: DataFrame, max_length: int, buffer_factor: int = BUFFER_FACTOR, unit: Sequence[str] = UNIT
) -> DataFrame:
    """Up to three segments per unit and length, as an array column.

    A group is one unit's histogram: one row per distinct length.
    """
    types = dict(histogram.dtypes)
    keys = ", ".join(f"{name} {types[name]}" for name in (*unit, "seq_length"))
    nested = ", ".join(piece.replace(" ", ": ", 1) for piece in SEGMENT.split(", "))

    def per_unit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq_length")
        segments = layout(
            list(zip(rows["seq_length"].to_pylist(), rows["_rows"].to_pylist())), max_length, buffer_factor
        )
        fields = [piece.split() for piece in SEGMENT.split(", ")]
        structs = pa.StructArray.from_arrays(
            [pa.array([s[name] for s in segments], ARROW_TYPES[type_]) for name, type_ in fields],
            names=[name for name, _ in fields],
        )
        # Segments come in the order of the lengths, a few for each.
        per_length = Counter(s["length"] for s in segments)
        ends = np.cumsum([0, *(per_length[length] for length in rows["seq_length"].to_pylist())])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
        return rows.select([*unit, "seq_length"]).append_column("segments", lists)

    return histogram.groupBy(*unit).applyInArrow(per_unit, f"{keys}, segments array<struct<{nested}>>")


def plan_packing(
    lengths: DataFrame,
    max_length: int,
    buffer_factor: int = BUFFER_FACTOR,
    unit: Sequence[str] = UNIT,
    row_id: str = "row_id",
    bucket: Column | None = None,
) -> DataFrame:
    """Place every row: add ``buffer``, ``bin``, ``pos`` and ``residual``.

    ``lengths`` has the unit columns, an integer ``row_id`` unique in its unit,
    and ``seq_length`` of at least 1; equal lengths keep ``row_id`` order. ``residual`` marks rows
    of a bin still open when its buffer filled up: the reference drops those,
    ``packed_rows`` keeps them unless told otherwise. A row longer than
    ``max_length`` has a bin to itself and leaves the open bin alone. ``bucket``
    cuts a run of equal lengths into tasks and must not decrease with ``row_id``.
    """
    unit = list(unit)
    run = [*unit, "seq_length"]
    bucket = bucket if bucket is not None else id_bucket(row_id)
    histogram = lengths.groupBy(*run).agg(F.count(F.lit(1)).alias("_rows"))
    segments = packing_segments(histogram, max_length, buffer_factor, unit)
    placed = with_positions(lengths, run, [row_id], bucket, "_rank", per_key=segments)
    own = F.filter("segments", lambda s: (s["first"] <= F.col("_rank")) & (F.col("_rank") < s["last"]))[0]
    found = placed.withColumn("_s", own).withColumn("_offset", F.col("_rank") - F.col("_s.first"))
    at = F.pmod("_offset", F.col("_s.period"))
    joins_open = at < F.col("_s.room")
    beyond = at - F.col("_s.room")
    bin_ = F.when(joins_open, F.col("_s.bin")).otherwise(F.col("_s.after") + 1 + whole(beyond, F.col("_s.fit")))
    pos = F.when(joins_open, F.col("_s.members") + at).otherwise(F.pmod(beyond, F.col("_s.fit")))
    return (
        found.withColumn("buffer", F.col("_s.buffer") + whole(F.col("_offset"), F.col("_s.period")))
        .withColumn("bin", bin_)
        .withColumn("pos", pos)
        .withColumn("residual", ~F.col("_s.alone") & (F.col("bin") == F.col("_s.open_bin")))
        .select(*lengths.columns, "buffer", "bin", "pos", "residual")
    )


def pack(
    tokens: DataFrame,
    max_length: int,
    buffer_factor: int = BUFFER_FACTOR,
    unit: Sequence[str] = UNIT,
    row_id: str = "row_id",
    keep_residual: bool = True,
    seed: int = 0,
    strict: bool = False,
    ids: str = "input_ids",
    labels: str = "labels",
    buffers_together: int = BUFFERS_TOGETHER,
    hidden: str | None = None,
    plan: DataFrame | None = None,
) -> DataFrame:
    """Packed ids and labels, shuffled within each buffer.

    With ``hidden``, a column of how many leading labels are masked, the labels
    are made from the ids once a bin is together, and need not move; the ids may
    then be packed, as ``tokenise_packed`` has them, and become arrays at the end. Without
    ``plan``, of ``plan_packing``, the lengths are read apart, so ``tokens`` should
    be a stored table or pass through ``cut_lineage``. Bins and buffers are bounded
    by ``max_length`` and the buffer size, so no group here grows with the data.
    ``shuffle_pos`` is the row's place in its buffer. Runs of
    ``buffers_together`` buffers go to one task, so that writing by unit gives
    files of that many buffers rather than one file per task and unit.
    """
    unit = list(unit)
    if plan is None:
        plan = plan_packing(tokens.select(*unit, row_id, "seq_length"), max_length, buffer_factor, unit, row_id)
    carried = [ids, hidden or labels]
    packed = dict(tokens.dtypes)[ids] == "binary"
    if packed and hidden is None:
        raise ValueError("packed ids need the column of how many labels are masked")
    placed = tokens.select(*unit, row_id, *carried).join(plan, [*unit, row_id])
    cut = placed.withColumn(ids, F.substring(ids, 1, ID_BYTES * max_length) if packed else F.slice(ids, 1, max_length))
    if hidden is None:
        cut = cut.withColumn(labels, F.slice(labels, 1, max_length))
        masked = all_masked(labels)
    else:
        masked = F.col(hidden) >= max_length
    useless = (F.col("seq_length") > max_length) & masked
    if strict:
        message = F.format_string("row of %d tokens has only masked labels", F.col("seq_length"))
        keep = F.when(useless, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    else:
        keep = ~useless
    if not keep_residual:
        keep = keep & ~F.col("residual")
    members = F.sort_array(F.collect_list(F.struct("pos", *carried)))
    # Partitioned once, for both the bins and their order in the buffer.
    grouped = [*unit, "_together", "buffer"]
    bins = (
        cut.filter(keep)
        .withColumn("_together", whole(F.col("buffer"), F.lit(buffers_together)))
        .repartition(*unit, "_together")
        .groupBy(*grouped, "bin")
        .agg(members.alias("_members"))
    )
    in_buffer = Window.partitionBy(*grouped).orderBy(shuffle_key(seed, *unit, "buffer", "bin"))
    place = [*unit, "buffer", "bin", (F.row_number().over(in_buffer) - 1).alias("shuffle_pos")]
    if packed:
        both = joined_members(F.col(f"_members.{ids}"), F.col(f"_members.{hidden}"), IGNORE_INDEX)
        joined = bins.select(*place, "_members").withColumn("_joined", both)
        return joined.select(*unit, "buffer", "bin", "shuffle_pos", F.col("_joined.ids").alias(ids), F.col("_joined.labels").alias(labels))
    return bins.select(
        *place,
        flatten_members("_members", ids).alias(ids),
        (flatten_members("_members", labels) if hidden is None else _member_labels("_members", ids, hidden)).alias(labels),
    )


def _member_labels(members: str, ids: str, hidden: str) -> Column:
    """The members' ids joined in order, the first ``hidden`` of each masked."""
    return F.flatten(F.transform(members, lambda member: masked_labels(member[ids], member[hidden])))


def flatten_members(members: str, field: str) -> Column:
    """The members' arrays joined in order."""
    return F.flatten(F.transform(members, lambda member: member[field]))


def shuffle_key(seed: int, *columns: str) -> Column:
    """A repeatable random order: the digest of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sort_units(tokens: DataFrame, unit: Sequence[str] = UNIT, row_id: str = "row_id") -> DataFrame:
    """Rows in ascending length per unit, split by range so no unit is one task.

    Written out, the files of a unit in order are the sorted unit.
    """
    order = [*unit, "seq_length", row_id]
    return tokens.repartitionByRange(*order).sortWithinPartitions(*order)


def packing_stats(plan: DataFrame, unit: Sequence[str] = UNIT, keep_residual: bool = True) -> DataFrame:
    """Input rows, packed rows and their ratio per unit and, with null keys, in total.

    A bin has one row at position 0, so packed rows need no distinct count.
    """
    kept = F.lit(True) if keep_residual else ~F.col("residual")
    return plan.rollup(*unit).agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if((F.col("pos") == 0) & kept).alias("packed_rows"),
        F.count_if(F.col("residual")).alias("residual_rows"),
        F.sum(F.when(F.col("residual"), F.col("seq_length")).otherwise(0)).alias("residual_tokens"),
    ).withColumn("ratio", F.round(F.col("packed_rows") / F.col("input_rows"), 6))


def running_rows(stats: DataFrame, unit: Sequence[str] = UNIT) -> DataFrame:
    """Input rows of the units so far, in unit order; one row per unit."""
    so_far = Window.partitionBy(F.lit(0)).orderBy(*unit).rowsBetween(Window.unboundedPreceding, 0)
    units = stats.filter(" and ".join(f"{name} is not null" for name in unit))
    return units.withColumn("running_rows", F.sum("input_rows").over(so_far))
