"""Training input: epochs, rank shards, resumable batches, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.filters import IGNORE_INDEX
from millrace.operators.ordered import digest_bucket, sketch_bucket, with_positions


def with_epochs(rows: DataFrame, epochs: int) -> DataFrame:
    """Every row once per epoch; the number of epochs is a parameter."""
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def rank_shards(
    rows: DataFrame,
    ranks: int,
    row_id: str = "row_id",
    seed: int = 0,
    shuffle: bool = True,
    drop_last: bool = False,
    start_index: int = 0,
    resume_epoch: int = 0,
) -> DataFrame:
    """Deal the rows of each epoch to ranks, as ``rank`` and ``rank_pos``.

    The order is a digest of seed plus epoch and row id, or the row id itself.
    Rows wrap around to fill the last round of ranks, or with ``drop_last`` the
    incomplete round is left out. A resumed run has no rows of epochs before
    ``resume_epoch``, starts that one at ``start_index``, and reads later ones
    whole; ``rank_rows`` is how many rows a rank then has.
    """
    start = F.when(F.col("epoch") == resume_epoch, start_index).otherwise(0)
    rows = rows.filter(F.col("epoch") >= resume_epoch)
    if shuffle:
        mixed = F.concat_ws(":", (F.lit(seed) + F.col("epoch")).cast("string"), F.col(row_id).cast("string"))
        ordered = rows.withColumn("_order", F.md5(mixed))
        order, bucket = ["_order", row_id], digest_bucket("_order")
    else:
        ordered, order, bucket = rows.withColumn("_order", F.col(row_id)), ["_order"], sketch_bucket(rows, row_id)
    numbered = with_positions(ordered, ["epoch"], order, bucket, "_pos", count="_n")
    n = F.col("_n")
    if drop_last:
        # Whole rounds only: a remainder is left out.
        rounds = F.floor(n / ranks)
        places = F.when(F.col("_pos") < rounds * ranks, F.array(F.col("_pos")))
    else:
        rounds = F.ceil(n / ranks)
        places = F.sequence(F.col("_pos"), rounds * ranks - 1, n)
    dealt = numbered.withColumn("_rounds", rounds).withColumn("_place", F.explode(places))
    return (
        dealt.withColumn("rank", F.pmod("_place", F.lit(ranks)).cast("int"))
        .withColumn("rank_pos", F.floor(F.col("_place") / ranks) - start)
        .withColumn("rank_rows", F.greatest(F.col("_rounds") - start, F.lit(0)))
        .filter(F.col("rank_pos") >= 0)
        .drop("_order", "_pos", "_n", "_rounds", "_place")
    )


def with_batches(sharded: DataFrame, batch_size: int, drop_last: bool = True) -> DataFrame:
    """Batch number and place in the batch, within each epoch and rank.

    The rank's row count is known, so full batches are found by arithmetic.
    """
    batched = sharded.withColumn("batch", F.floor(F.col("rank_pos") / batch_size)).withColumn(
        "batch_pos", F.pmod("rank_pos", F.lit(batch_size)).cast("int")
    )
    if drop_last:
        batched = batched.filter((F.col("batch") + 1) * batch_size <= F.col("rank_rows"))
    return batched


def resume_offset(states: DataFrame, batch_size: int) -> DataFrame:
    """Start index of each checkpoint: its step times the batch size."""
    return states.withColumn("sample_start_index", F.col("step") * batch_size)


def epoch_start(states: DataFrame, epoch: Column) -> Column:
    """Start index of ``epoch`` when resuming from a state: later epochs start at 0."""
    return F.when(epoch == states["epoch"], states["sample_start_index"]).otherwise(F.lit(0))


def pad(
    rows: DataFrame,
    pad_id: int,
    max_length: int = 4096,
    side: str = "right",
    padding: str = "max_length",
    batch: tuple[str, ...] = ("epoch", "rank", "batch"),
    ignore_index: int = IGNORE_INDEX,
) -> DataFrame:
    """Cut and pad ``input_ids`` and ``labels``, and add ``attention_mask``.

    Right padding fills to ``max_length`` unless ``padding`` is something else,
    in which case, as always on the left, a batch is filled to its longest row.
    The mask is false wherever the id is the pad id, also inside the row.
    """
    if not isinstance(pad_id, int) or pad_id < 0:
        raise ValueError("pad_id is a non-negative integer")
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    cut = rows.withColumn("input_ids", F.slice("input_ids", 1, max_length)).withColumn(
        "labels", F.slice("labels", 1, max_length)
    )
    if side == "right" and padding == "max_length":
        width = F.lit(max_length)
    else:
        # A batch has at most batch_size rows.
        width = F.max(F.size("input_ids")).over(Window.partitionBy(*batch))
    sized = cut.withColumn("_width", width)

    def filled(column: str, value: int) -> Column:
        gap = F.array_repeat(F.lit(value), F.col("_width") - F.size(column))
        return F.concat(gap, F.col(column)) if side == "left" else F.concat(F.col(column), gap)

    return (
        sized.withColumn("input_ids", filled("input_ids", pad_id))
        .withColumn("labels", filled("labels", ignore_index))
        .withColumn("attention_mask", F.transform("input_ids", lambda token: token != pad_id))
        .drop("_width")
    )
