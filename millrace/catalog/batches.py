"""Rank shards, batches, padding and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.bindings import LENGTHS, bind
from millrace.catalog.corpus import array_digest
from millrace.catalog.registry import query
from millrace.operators import batches, permutation
from millrace.operators.ordered import id_bucket, with_positions
from millrace.session import cut_lineage

RANKS, SIZE, SEED = 7, 12, 42


def dealt(epochs: int, ranks: int, start: int = 0, drop_last: bool = False) -> str:
    """Rows in digest order, wrapped or cut to whole rounds, dealt to ranks."""
    rounds = f"floor(n / {ranks}.0)" if drop_last else f"ceil(n / {ranks}.0)"
    return f"""
v as (select row_id, part, seq_length from ({LENGTHS})),
epochs as (select v.*, cast(e.epoch as int) as epoch from v cross join (select unnest(range({epochs})) as epoch) e),
ordered as (select *, row_number() over (partition by epoch order by md5(concat_ws(':', {SEED} + epoch, row_id))) - 1 as p,
   count(*) over (partition by epoch) as n from epochs),
wrapped as (select *, p as place from ordered union all select *, p + n from ordered),
dealt as (select row_id, part, seq_length, epoch, cast(place % {ranks} as int) as rank,
   place // {ranks} - {start} as rank_pos, cast({rounds} - {start} as bigint) as rank_rows
   from wrapped where place < {rounds} * {ranks} and place // {ranks} >= {start})
"""


def _rows(spark, sf_dir, epochs):
    rows = bind(spark, sf_dir, LENGTHS).select("row_id", "part", "seq_length")
    return batches.with_epochs(rows, epochs)


@query("rank_shards", f"with {dealt(2, RANKS)} select * from dealt")
def rank_shards(spark, sf_dir):
    return batches.rank_shards(_rows(spark, sf_dir, 2), RANKS, seed=SEED)


@query("rank_shards_whole_rounds", f"with {dealt(1, RANKS, drop_last=True)} select * from dealt")
def rank_shards_whole_rounds(spark, sf_dir):
    return batches.rank_shards(_rows(spark, sf_dir, 1), RANKS, seed=SEED, drop_last=True)


BATCHED = f"""
{dealt(1, RANKS, SIZE)},
batched as (select *, rank_pos // {SIZE} as batch, cast(rank_pos % {SIZE} as int) as batch_pos from dealt)
"""


def _batched(spark, sf_dir):
    sharded = batches.rank_shards(_rows(spark, sf_dir, 1), RANKS, seed=SEED, start_index=SIZE)
    return batches.with_batches(sharded, SIZE)


@query("resumed_batches", f"with {BATCHED} select * from batched where (batch + 1) * {SIZE} <= rank_rows")
def resumed_batches(spark, sf_dir):
    return _batched(spark, sf_dir)


@query(
    "resumed_epochs",
    f"""with {dealt(3, RANKS)} select row_id, part, seq_length, epoch, rank,
      case when epoch = 1 then rank_pos - {SIZE} else rank_pos end as rank_pos,
      case when epoch = 1 then greatest(rank_rows - {SIZE}, 0) else rank_rows end as rank_rows
    from dealt where epoch >= 1 and (epoch > 1 or rank_pos >= {SIZE})""",
)
def resumed_epochs(spark, sf_dir):
    return batches.rank_shards(_rows(spark, sf_dir, 3), RANKS, seed=SEED, start_index=SIZE, resume_epoch=1)


@query(
    "epochs_in_digest_order",
    f"""with {dealt(3, 1)} select epoch, row_id, rank_pos as place from dealt""",
)
def epochs_in_digest_order(spark, sf_dir):
    rows = batches.rank_shards(_rows(spark, sf_dir, 3), 1, seed=SEED)
    return rows.select("epoch", "row_id", F.col("rank_pos").alias("place"))


@query(
    "resume_offsets",
    "select event_id as step, cast(event_id % 3 as int) as epoch, event_id * 12 as sample_start_index, "
    "case when event_id % 3 = 1 then event_id * 12 else 0 end as start_of_epoch_1 from events",
)
def resume_offsets(spark, sf_dir):
    states = bind(spark, sf_dir, "select event_id as step, cast(event_id % 3 as int) as epoch from events")
    offsets = batches.resume_offset(states, SIZE)
    return offsets.select("*", batches.epoch_start(offsets, F.lit(1)).alias("start_of_epoch_1"))


def permuted_sql(epochs: int, ranks: int, drop_last: bool = False) -> str:
    """The rounds of the permutation, one a step; a row outside goes on with round 0."""
    keys = ", ".join(
        f"({epoch}, {turn}, {a}, {b}, {c})"
        for epoch in range(epochs)
        for turn, (a, b, c) in enumerate(permutation.round_keys(SEED, epoch))
    )

    def mixed(side: str) -> str:
        linear = f"(({side} % {permutation.PRIME} * a + b) % {permutation.PRIME})"
        return f"(({linear} * {linear} + c) % {permutation.PRIME})"

    rounds = f"floor(n / {ranks}.0)" if drop_last else f"ceil(n / {ranks}.0)"
    return f"""
keys(epoch, turn, a, b, c) as (values {keys}),
v as (select row_id, part, row_number() over (order by row_id) - 1 as number, count(*) over () as n from ({LENGTHS})),
sized as (select *, cast(floor(sqrt(n - 1)) as bigint) + 1 as height from v),
walk as (
  select e.epoch, number, n, height, cast(ceil(n / height) as bigint) as width, number // cast(ceil(n / height) as bigint) as x,
    number % cast(ceil(n / height) as bigint) as y, 0 as turn from sized cross join (select distinct epoch from keys) e
  union all
  select w.epoch, number, n, height, width, case when k.turn % 2 = 0 then (x + {mixed("y")}) % height else x end,
    case when k.turn % 2 = 1 then (y + {mixed("x")}) % width else y end, k.turn + 1
  from walk w join keys k on k.epoch = w.epoch
    and k.turn = case when w.turn = {permutation.ROUNDS} and x * width + y >= n then 0 else w.turn end),
placed as (select epoch, number, n, x * width + y as p from walk where turn = {permutation.ROUNDS} and x * width + y < n),
wrapped as (select *, p as place from placed union all select *, p + n from placed),
dealt as (select v.row_id, v.part, v.number as row_number, cast(epoch as int) as epoch, cast(place % {ranks} as int) as rank,
  place // {ranks} as rank_pos, cast({rounds} as bigint) as rank_rows
  from wrapped join (select row_id, part, number from v) v using (number) where place < {rounds} * {ranks})
"""


def _numbered(spark, sf_dir):
    """The rows with their stored numbers, and how many they are."""
    rows = bind(spark, sf_dir, LENGTHS).select("row_id", "part")
    stored = cut_lineage(with_positions(rows, [], ["row_id"], id_bucket("row_id"), "row_number"), "numbered-rows")
    return stored, stored.count()


@query("permuted_shards", f"with recursive {permuted_sql(2, RANKS)} select * from dealt")
def permuted_shards(spark, sf_dir):
    rows, count = _numbered(spark, sf_dir)
    return permutation.permuted_shards(rows, count, RANKS, 2, seed=SEED)


@query(
    "permuted_epochs_resumed",
    f"""with recursive {permuted_sql(3, RANKS, True)} select row_id, part, row_number, epoch, rank,
      case when epoch = 1 then rank_pos - {SIZE} else rank_pos end as rank_pos,
      case when epoch = 1 then greatest(rank_rows - {SIZE}, 0) else rank_rows end as rank_rows
    from dealt where epoch >= 1 and (epoch > 1 or rank_pos >= {SIZE})""",
)
def permuted_epochs_resumed(spark, sf_dir):
    rows, count = _numbered(spark, sf_dir)
    return permutation.permuted_shards(rows, count, RANKS, 3, seed=SEED, drop_last=True, start_index=SIZE, resume_epoch=1)


@query(
    "rows_left_of_a_rank",
    f"with recursive {permuted_sql(1, RANKS)} select row_id, row_number, rank_pos from dealt where rank = 3 and rank_pos >= {SIZE}",
)
def rows_left_of_a_rank(spark, sf_dir):
    rows, count = _numbered(spark, sf_dir)
    left = permutation.numbers_left(spark, count, RANKS, 3, 0, SEED, SIZE)
    return rows.join(left, "row_number").select("row_id", "row_number", "rank_pos")


def padded_sql(side: str, width: str) -> str:
    def filled(values: str, pad: str) -> str:
        gap = f"list_transform(range({width} - len({values})), lambda i: {pad})"
        return f"list_concat({gap}, {values})" if side == "left" else f"list_concat({values}, {gap})"

    return f"""with {BATCHED}, cut as (select *, list_transform(range(least(seq_length, 512)), lambda i: i % 5) as ids,
       list_transform(range(least(seq_length, 512)), lambda i: i) as labs
       from batched where (batch + 1) * {SIZE} <= rank_rows),
    wide as (select *, max(len(ids)) over (partition by epoch, rank, batch) as longest from cut),
    padded as (select *, {filled("ids", "4")} as input_ids, {filled("labs", "-100")} as labels from wide)
    select epoch, rank, batch, batch_pos, md5(array_to_string(input_ids, ',')) as input_ids,
      md5(array_to_string(labels, ',')) as labels, cast(len(list_filter(input_ids, lambda t: t <> 4)) as int) as attended,
      cast(len(input_ids) as int) as width
    from padded"""


def _padded(spark, sf_dir, **options):
    rows = _batched(spark, sf_dir).withColumn("labels", F.sequence(F.lit(0), F.col("seq_length") - 1))
    rows = rows.withColumn("input_ids", F.transform("labels", lambda i: F.pmod(i, F.lit(5))))
    padded = batches.pad(rows, pad_id=4, max_length=512, **options)
    return padded.select(
        "epoch",
        "rank",
        "batch",
        "batch_pos",
        array_digest("input_ids"),
        array_digest("labels"),
        F.size(F.filter("attention_mask", lambda m: m)).alias("attended"),
        F.size("input_ids").alias("width"),
    )


@query("padded_to_length", padded_sql("right", "512"))
def padded_to_length(spark, sf_dir):
    return _padded(spark, sf_dir)


@query("padded_to_longest", padded_sql("right", "longest"))
def padded_to_longest(spark, sf_dir):
    return _padded(spark, sf_dir, padding="longest")


@query("padded_left", padded_sql("left", "longest"))
def padded_left(spark, sf_dir):
    return _padded(spark, sf_dir, side="left")
