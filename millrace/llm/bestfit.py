"""Best-fit packing into bins of several permitted capacities.

Pieces are placed in descending length, each into the open bin with the least
room that still holds it, the earliest of equals. If none does, the capacity that costs least per token
it can be expected to hold is opened: its expected fill is the piece plus as many
tokens of the remaining pieces as are short enough for the rest. At the end every
bin is downsized to the smallest capacity that holds its contents.

Pieces of one length are interchangeable, so the fold runs over the histogram of
lengths, of at most the largest capacity's entries, and moves whole runs of equal
bins at once. Its result is a table of runs: which ranks of a length go to which
bins, and where in them. Every row finds its own run by its rank; no group of
rows is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import per_batch, texts_of
from millrace.operators.ordered import with_positions
from millrace.session import cut_lineage

CAPACITIES = (512, 1024, 2048, 4096)
BUCKET_BITS = 10


def default_cost(capacity: int) -> float:
    """Cost of one sequence: linear layers, and attention that grows with the square."""
    return capacity + capacity * capacity / 8192


@dataclass
class Plan:
    """Runs of pieces and of bins.

    ``runs``: length, first rank, first bin, pieces in each bin, offset of the first piece in its bin.
    ``bins``: first bin, tokens used, capacity after downsizing.
    """

    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: list[tuple[int, int, int]] = field(default_factory=list)
    count: int = 0


def opened_capacity(length: int, capacities: Sequence[int], cost, shorter: np.ndarray) -> int:
    """The capacity to open for a piece; ``shorter[n]`` are the tokens of unplaced pieces of at most n tokens."""

    def price(capacity: int) -> float:
        room = capacity - length
        return cost(capacity) / (length + min(room, int(shorter[min(room, length)])))

    return min((c for c in sorted(capacities, reverse=True) if c >= length), key=price)


def plan_bins(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost=default_cost) -> Plan:
    """Places the pieces of ``histogram`` (length to their number, none longer than the largest capacity)."""
    plan, largest = Plan(), max(capacities)
    # Open bins by room, earliest first: runs of (first bin, number of bins, capacity opened).
    rooms: list[list[tuple[int, int, int]]] = [[] for _ in range(largest + 1)]
    left = np.zeros(largest + 1, np.int64)
    for length, number in histogram.items():
        left[length] = number
    for length in sorted(histogram, reverse=True):
        number, rank, room = int(histogram[length]), 0, length
        capacity = opened_capacity(length, capacities, cost, np.cumsum(left * np.arange(largest + 1)))
        while rank < number:
            while room <= largest and not rooms[room]:
                room += 1
            if room <= largest:
                size = room
                first, bins, opened = heappop(rooms[room])
            else:
                size = opened = capacity
                first, bins = plan.count, -(-(number - rank) // (size // length))
                plan.count += bins
            # The fullest bin that fits stays the fullest until it is full, so bins fill one by one.
            each = size // length
            full, rest = divmod(min(number - rank, bins * each), each)
            for at, some, pieces in ((first, full, each), (first + full, int(rest > 0), rest)):
                if some:
                    plan.runs.append((length, rank, at, pieces, opened - size))
                    heappush(rooms[size - pieces * length], (at, some, opened))
                    rank += some * pieces
            used = full + (rest > 0)
            if used < bins:
                heappush(rooms[size], (first + used, bins - used, opened))
        left[length] = 0
    for room, runs in enumerate(rooms):
        for first, _, opened in runs:
            plan.bins.append((first, opened - room, min(c for c in capacities if c >= opened - room)))
    plan.bins.sort()
    return plan


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens, the white-space words of the text and one end, for every row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batch: pa.RecordBatch):
        return [batch.column(0), pa.array([len((text or b"").split()) + 1 for text in texts_of(batch, 1)], pa.int64())]

    return per_batch(docs.select("doc_id", "text"), count, f"doc_id {kind}, n_tokens long")


def best_fit(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, cost=default_cost) -> DataFrame:
    """Where the tokens of every row of ``lengths`` (doc_id, n_tokens) go.

    doc_id, piece, start (in the document), n_tokens, bin, offset (in the bin),
    bin_tokens and capacity. A row longer than the largest capacity is cut into
    pieces of that length and a rest; rows without tokens (null, 0 or less) have
    no piece. Rows of one id, or without id, are placed apart. Pieces of a
    length take their ranks by the hash of their id, so their order is
    repeatable but for rows that do not differ. An empty table gives an empty
    result. Other columns are not read.
    """
    largest = max(capacities)
    cut = lengths.select("doc_id", F.col("n_tokens").cast("long").alias("total")).filter("total > 0")
    cut = cut.select("doc_id", "total", F.explode(F.expr(f"sequence(0, (total - 1) div {largest})")).alias("piece"))
    pieces = cut_lineage(
        cut.select(
            "doc_id",
            "piece",
            (F.col("piece") * largest).alias("start"),
            F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).alias("n_tokens"),
            F.xxhash64("doc_id", "piece", "total").alias("place"),
        ),
        "pieces",
    )
    histogram = {row[0]: row[1] for row in pieces.groupBy("n_tokens").count().collect()}
    plan = plan_bins(histogram, capacities, cost)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    bins = np.array(plan.bins, np.int64).reshape(-1, 3)
    tables = lengths.sparkSession.sparkContext.broadcast((runs, bins))
    ranked = with_positions(
        pieces,
        ["n_tokens"],
        ["place", "doc_id", "piece"],
        F.shiftright(F.col("place"), 64 - BUCKET_BITS),
        position="rank",
    )

    def place(batch: pa.RecordBatch):
        by_rank, by_bin = tables.value
        length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        run = np.empty(len(length), np.int64)
        for each in np.unique(length):
            low, high = np.searchsorted(by_rank[:, 0], [each, each + 1])
            mine = length == each
            run[mine] = low + np.searchsorted(by_rank[low:high, 1], rank[mine], "right") - 1
        inside = rank - by_rank[run, 1]
        number = by_rank[run, 2] + inside // by_rank[run, 3]
        offset = by_rank[run, 4] + inside % by_rank[run, 3] * length
        into = np.searchsorted(by_bin[:, 0], number, "right") - 1
        return [*batch.columns[:4], pa.array(number), pa.array(offset), pa.array(by_bin[into, 1]), pa.array(by_bin[into, 2])]

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return per_batch(
        ranked.select("doc_id", "piece", "start", "n_tokens", "rank"),
        place,
        f"doc_id {kind}, piece long, start long, n_tokens long, bin long, offset long, bin_tokens long, capacity long",
    )
