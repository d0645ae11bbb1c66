"""Roles of transcript lines by a hidden Markov model, and their canonical form.

The states are a role and whether a line begins a turn; the observations are the
speaker marker of a line and its length class. The model is counted on lines with
known roles. A conversation is decoded exactly however long it is: its lines are
cut into chunks, each chunk becomes a matrix of best path scores between its ends
(max-plus), matrices are multiplied in groups level by level, and the states at
the ends of the chunks are then read back down.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function
from millrace.operators.ordered import whole, with_positions, with_range_bucket
from millrace.session import cut_lineage

ROLES = ("system", "user", "assistant")
# Speaker markers as they occur in transcripts, by role.
MARKERS = {
    "system": "system|context|instructions?",
    "user": "user|human|you|question|q",
    "assistant": "assistant|ai|bot|gpt|model|answer|a",
}
MARKER_PATTERN = r"^[\s>*#\[(<|-]{{0,8}}(?i:{names})[\s\])>|*]{{0,8}}(?:[:：][\s*]{{0,8}}|$)"
LENGTHS = (40, 160, 640)
CLASSES = len(LENGTHS) + 1
OBSERVATIONS = (len(ROLES) + 1) * CLASSES
# Two states a role: begins a turn, goes on; and one before the first line.
STATES = 2 * len(ROLES)
START = STATES
CHUNK = 256
TURN_BUCKET = 4096
SMOOTHING = 0.5
SAME = "array<int>"


def marker_of(line: Column) -> Column:
    """1-based place of the role whose marker opens the line, 0 if none does."""
    found = F.lit(0)
    for at, role in reversed(list(enumerate(ROLES))):
        found = F.when(line.rlike(MARKER_PATTERN.format(names=MARKERS[role])), at + 1).otherwise(found)
    return found


def without_marker(line: Column) -> Column:
    return F.regexp_replace(line, MARKER_PATTERN.format(names="|".join(MARKERS.values())), "")


def observation(line: Column) -> Column:
    size = F.lit(0)
    for at, limit in enumerate(LENGTHS):
        size = F.when(F.length(line) > limit, at + 1).otherwise(size)
    return (marker_of(line) * CLASSES + size).cast("int")


def numbered_lines(turns: DataFrame) -> DataFrame:
    """One row for every line of ``turns`` (conv_id, turn, text and others), the ``line`` of ``lines`` in the conversation.

    A null text is one empty line. Null ids are one conversation; null turns come
    first. Texts of one turn follow each other whole, in the order of a hash; equal
    texts of one turn in no fixed order. A turn of many lines, or many texts of one
    turn, are numbered in blocks of a range each.
    """
    others = [name for name in turns.columns if name not in ("conv_id", "turn", "text")]
    split = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conversation"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.xxhash64("text").alias("_text"),
        # Tells equal texts apart.
        F.monotonically_increasing_id().alias("_row"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text"),
        "conv_id",
        *others,
    )
    order = ["turn", "_text", "_row", "at"]
    ranged = with_range_bucket(split, "conversation", *order)
    placed = with_positions(ranged, ["conversation"], order, F.col("range_bucket"), position="line", count="lines")
    return placed.drop("_text", "_row", "range_bucket")


@dataclass
class Chain:
    """Log probabilities: ``moves`` from each state and START to each state, ``emits`` of each observation by state."""

    moves: np.ndarray
    emits: np.ndarray

    def matrix(self, seen: list[int]) -> np.ndarray:
        """Best score of a path through ``seen`` from each state before it to each state at its end."""
        best = self.moves + self.emits[:, seen[0]]
        for code in seen[1:]:
            best = (best[:, :, None] + self.moves[None, :STATES]).max(axis=1) + self.emits[:, code]
        return best

    def path(self, seen: list[int], enter: int, leave: int) -> list[int]:
        """The best states for ``seen`` after ``enter``, ending in ``leave``; the first of equal ones."""
        best, back = self.moves[enter] + self.emits[:, seen[0]], []
        for code in seen[1:]:
            through = best[:, None] + self.moves[:STATES]
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + self.emits[:, code]
        states = [leave]
        for step in reversed(back):
            states.append(int(step[states[-1]]))
        return states[::-1]


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """Max-plus product of score matrices from STATES + 1 states to STATES."""
    best = matrices[0]
    for matrix in matrices[1:]:
        best = (best[:, :, None] + matrix[None, :STATES]).max(axis=1)
    return best


def boundaries(matrices: list[np.ndarray], enter: int, leave: int) -> list[tuple[int, int]]:
    """The states before and at the end of each of ``matrices`` on the best path from ``enter`` to ``leave``."""
    best, back = matrices[0][enter], []
    for matrix in matrices[1:]:
        through = best[:, None] + matrix[:STATES]
        back.append(through.argmax(axis=0))
        best = through.max(axis=0)
    ends = [leave]
    for step in reversed(back):
        ends.append(int(step[ends[-1]]))
    ends.reverse()
    return list(zip([enter, *ends[:-1]], ends, strict=True))


def fit(lines: DataFrame) -> Chain:
    """Counts the chain on ``lines`` (conversation, line, at, role, seen); lines with other roles are left out."""
    role = F.lit(None).cast("int")
    for at, name in enumerate(ROLES):
        role = F.when(F.lower("role") == name, at).otherwise(role)
    known = lines.withColumn("state", 2 * role + (F.col("at") > 0).cast("int")).filter("state is not null")
    known = cut_lineage(known.select("conversation", "line", "state", "seen"), "known-lines")
    emits = np.full((STATES, OBSERVATIONS), SMOOTHING)
    for state, seen, number in known.groupBy("state", "seen").count().collect():
        emits[state, seen] += number
    before = known.select("conversation", (F.col("line") + 1).alias("line"), F.col("state").alias("previous"))
    moves = np.full((STATES + 1, STATES), SMOOTHING)
    moved = known.join(before, ["conversation", "line"], "left").withColumn("first", F.col("line") == 0)
    moved = moved.groupBy("previous", "state", "first").count()
    for previous, state, first, number in moved.collect():
        if first:
            moves[START, state] += number
        elif previous is not None:
            moves[previous, state] += number
    # Only a line that begins a turn can be first or follow another role.
    for role in range(len(ROLES)):
        inside = 2 * role + 1
        moves[[s for s in range(STATES + 1) if s not in (2 * role, inside)], inside] = 1e-9
    return Chain(*(np.log(m / m.sum(axis=1, keepdims=True)) for m in (moves, emits)))


def _levels(chunks: DataFrame, chain) -> list[DataFrame]:
    """Groups of matrices by level, from the chunks up to one group for each conversation."""
    def multiply(parts: pa.Array) -> pa.Array:
        rows = []
        for values in parts.to_pylist():
            matrices = np.array(values).reshape(-1, STATES + 1, STATES)
            rows.append(product(list(matrices)).ravel().tolist())
        return pa.array(rows, pa.list_(pa.float64()))

    def measure(parts: pa.Array) -> pa.Array:
        return pa.array([chain.value.matrix(seen).ravel().tolist() for seen in parts.to_pylist()], pa.list_(pa.float64()))

    current = chunks.select("conversation", "part", arrow_function(measure, "array<double>")("seen").alias("matrix"))
    levels = []
    while True:
        grouped = cut_lineage(
            current.withColumn("group", whole(F.col("part"), F.lit(CHUNK)))
            .groupBy("conversation", "group")
            .agg(F.sort_array(F.collect_list(F.struct("part", "matrix"))).alias("members")),
            "matrices",
        )
        levels.append(grouped)
        if grouped.filter("group > 0").isEmpty():
            return levels
        joined = F.flatten(F.transform("members", lambda m: m["matrix"]))
        current = grouped.select(
            "conversation", F.col("group").alias("part"), arrow_function(multiply, "array<double>")(joined).alias("matrix")
        )


def decode(lines: DataFrame, chain: Chain) -> DataFrame:
    """conversation, line and state for ``lines`` (conversation, line, seen) on the best path of each conversation."""
    shared = lines.sparkSession.sparkContext.broadcast(chain)
    chunks = cut_lineage(
        lines.groupBy("conversation", whole(F.col("line"), F.lit(CHUNK)).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("line", "seen"))).alias("rows"))
        .select("conversation", "part", F.transform("rows", lambda r: r["seen"]).alias("seen")),
        "chunks",
    )
    levels = _levels(chunks, shared)

    def split(parts: pa.Array, enter: pa.Array, leave: pa.Array) -> pa.Array:
        rows = []
        for values, before, after in zip(parts.to_pylist(), enter.to_pylist(), leave.to_pylist(), strict=True):
            matrices = list(np.array(values).reshape(-1, STATES + 1, STATES))
            if after is None:
                after = int(product(matrices)[before].argmax())
            rows.append([{"enter": a, "leave": b} for a, b in boundaries(matrices, before, after)])
        return pa.array(rows, pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32())])))

    def walk(seen: pa.Array, enter: pa.Array, leave: pa.Array) -> pa.Array:
        columns = zip(seen.to_pylist(), enter.to_pylist(), leave.to_pylist(), strict=True)
        return pa.array([shared.value.path(*row) for row in columns], pa.list_(pa.int32()))

    ends = None
    for level in reversed(levels):
        if ends is None:
            asked = level.withColumn("enter", F.lit(START)).withColumn("leave", F.lit(None).cast("int"))
        else:
            asked = level.join(ends.withColumnRenamed("part", "group"), ["conversation", "group"])
        joined = F.flatten(F.transform("members", lambda m: m["matrix"]))
        found = arrow_function(split, "array<struct<enter:int,leave:int>>")(joined, F.col("enter"), F.col("leave"))
        placed = asked.select("conversation", F.transform("members", lambda m: m["part"]).alias("parts"), found.alias("found"))
        ends = placed.select("conversation", F.inline(F.arrays_zip("parts", "found"))).select(
            "conversation", F.col("parts").alias("part"), "found.enter", "found.leave"
        )
    states = chunks.join(ends, ["conversation", "part"]).select(
        "conversation", "part", arrow_function(walk, SAME)(F.col("seen"), F.col("enter"), F.col("leave")).alias("states")
    )
    return states.select("conversation", "part", F.posexplode("states").alias("at", "state")).select(
        "conversation", (F.col("part") * CHUNK + F.col("at")).alias("line"), "state"
    )


def parse_transcripts(lines: DataFrame, chain: Chain) -> DataFrame:
    """``lines`` (of ``numbered_lines``, with seen) with found_turn, found_role and segment.

    The segments of a conversation, in line order, are its canonical form: each
    turn opened by its role and closed by an end mark, speaker markers removed.
    """
    found = decode(lines.select("conversation", "line", "seen"), chain)
    found = found.withColumn("opens", (F.col("state") % 2 == 0).cast("long"))
    counted = with_positions(
        cut_lineage(found, "states"),
        ["conversation"],
        ["line"],
        whole(F.col("line"), F.lit(TURN_BUCKET)),
        position="place",
        running={"opened": "opens"},
    ).select("conversation", "line", "state", "opened")
    placed = lines.join(counted, ["conversation", "line"])
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), whole(F.col("state"), F.lit(2)).cast("int"))
    opens = F.col("state") % 2 == 0
    body = F.when(opens, without_marker(F.col("text"))).otherwise(F.col("text"))
    opening = F.when(opens, F.concat(F.when(F.col("line") > 0, "<|end|>\n").otherwise(""), F.lit("<|"), role, F.lit("|>\n")))
    closing = F.when(F.col("line") == F.col("lines") - 1, "<|end|>\n").otherwise("")
    return placed.select(
        *lines.columns,
        F.greatest(F.col("opened") - 1, F.lit(0)).alias("found_turn"),
        role.alias("found_role"),
        F.concat(F.coalesce(opening, F.lit("\n")), body, closing).alias("segment"),
    )


def parsed(turns: DataFrame, folds: int = 5) -> DataFrame:
    """The lines of ``turns`` (conv_id, turn, role, text) with the turns and roles found in their texts.

    conv_id, line, turn, role (as given), held_out, found_turn, found_role and
    segment. The chain is counted on conversations whose id's crc32 is not 0
    modulo ``folds``; roles serve nothing else, so they may be null or unknown.
    Texts may be null (one empty line); null ids are one conversation; texts of
    one turn follow each other whole. Without labelled
    lines all paths are equally likely and the first states win. An empty table
    gives an empty result. Other columns are not read.
    """
    held_out = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % folds == 0
    lines = numbered_lines(turns.select("conv_id", "turn", "role", "text"))
    lines = cut_lineage(
        lines.withColumn("seen", observation(F.col("text"))).withColumn("held_out", held_out), "transcript-lines"
    )
    chain = fit(lines.filter("not held_out").select("conversation", "line", "at", "role", "seen"))
    return parse_transcripts(lines, chain).select(
        "conv_id", "line", "turn", "role", "held_out", "found_turn", "found_role", "segment"
    )
