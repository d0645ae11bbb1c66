"""Sharding, prompts, tokens and packing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from millrace.catalog.bindings import LENGTHS, SAMPLES, bind
from millrace.catalog.registry import query
from millrace.catalog.text import DATA_JSON, GRAPH_JSON, SAMPLES_MORE
from millrace.functions import templates
from millrace.functions.arrow import pieced_function
from millrace.operators import filters, ordered_packing, packing, prompts, sharding
from millrace.operators.ordered import sketch_bucket, spread, with_positions
from millrace.operators.tokens import tokenise, training_rows
from millrace.session import cut_lineage
from millrace.sinks.tables import shard_name

PACK_LENGTH = 512


@query(
    "folder_parts",
    f"""with s as ({SAMPLES}), numbered as (select folder, doc_id as file_id,
      row_number() over (partition by folder order by doc_id) - 1 as pos, count(*) over (partition by folder) as n from s)
    select folder, file_id, cast(floor(pos / ceil(n / 8.0)) as int) as part from numbered""",
)
def folder_parts(spark, sf_dir):
    files = bind(spark, sf_dir, SAMPLES).select("folder", F.col("doc_id").alias("file_id"))
    return sharding.assign_parts(files, num_parts=8)


@query(
    "merged_parts",
    f"""with s as ({SAMPLES}), numbered as (select folder, doc_id,
      row_number() over (partition by folder order by doc_id) - 1 as pos, count(*) over (partition by folder) as n from s),
    parts as (select *, cast(floor(pos / ceil(n / 8.0)) as int) as part from numbered)
    select part, concat('new_input_', part) as merged_folder, count(*) as files, count(distinct folder) as folders
    from parts group by part""",
)
def merged_parts(spark, sf_dir):
    files = bind(spark, sf_dir, SAMPLES).select("folder", F.col("doc_id").alias("file_id"))
    parts = sharding.assign_parts(files, num_parts=8)
    even, odd = parts.filter("folder < 'src3'"), parts.filter("folder >= 'src3'")
    # Folders per part through the folder's own partial counts: no distinct shuffle.
    per_folder = sharding.merge_parts(even, odd).groupBy("part", "merged_folder", "folder").agg(F.count(F.lit(1)).alias("n"))
    return per_folder.groupBy("part", "merged_folder").agg(
        F.sum("n").alias("files"), F.count(F.lit(1)).alias("folders")
    )


def _slices(bins: int) -> str:
    starts = sharding.slice_starts(bins)
    tests = " + ".join(f"(round_even(n * {start} / 100.0::double, 0) <= pos)::int" for start in starts)
    return f"""with v as (select row_id, part from ({LENGTHS})), numbered as (select *,
      row_number() over (partition by part order by row_id) - 1 as pos, count(*) over (partition by part) as n from v)
    select row_id, part, {tests} - 1 as split from numbered"""


@query("percent_slices", _slices(4))
def percent_slices(spark, sf_dir):
    return sharding.assign_slices(bind(spark, sf_dir, LENGTHS).select("row_id", "part"), bins=4)


@query("percent_slices_of_sixty", _slices(60))
def percent_slices_of_sixty(spark, sf_dir):
    return sharding.assign_slices(bind(spark, sf_dir, LENGTHS).select("row_id", "part"), bins=60)


SPARSE = f"""select case when row_id % 3 = 0 then row_id else row_id * 1000000007 end as row_id, part from ({LENGTHS})"""


@query(
    "percent_slices_of_sparse_ids",
    f"""with v as ({SPARSE}), placed as (select *, row_number() over (partition by part order by row_id) - 1 as pos,
      count(*) over (partition by part) as n from v)
    select row_id, part, pos, cast(len(list_filter([0, 25, 50, 75], lambda s: round_even(n * s / 100.0, 0) <= pos)) - 1 as int)
      as split from placed""",
)
def percent_slices_of_sparse_ids(spark, sf_dir):
    """Ids in one dense cluster and far apart, in buckets of a sketch."""
    rows = bind(spark, sf_dir, SPARSE)
    return sharding.assign_slices(rows, bucket=sketch_bucket(rows, "row_id", 100), position="pos")


def _sql(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


INFO_JSON = """concat('{"instruction set architecture": "', arch, '", "bit width": "', mode,
  '", "compiler optimization level": "', opts, '"}')"""


def filled(template: str, slots: dict[str, str]) -> str:
    """SQL for a template by replacing its slots one after the other."""
    out = _sql(template)
    for name, value in slots.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


SLOTS = {"assembly": "asm_ida_com", "data": DATA_JSON, "graph": GRAPH_JSON, "info": INFO_JSON}


def prompt_sql(name: str) -> str:
    single, several = (filled(text, SLOTS) for text in templates.TEMPLATES[name])
    return f"case when doc_id % 6 = 1 then {single} when doc_id % 6 > 1 then {several} end"


def _register_prompt(name: str):
    @query(f"prompt_{name}", f"with s as ({SAMPLES_MORE}) select doc_id, {prompt_sql(name)} as prompt from s")
    def prompt(spark, sf_dir):
        return prompts.with_prompt(bind(spark, sf_dir, SAMPLES), name).select("doc_id", "prompt")


for _name in templates.TEMPLATES:
    _register_prompt(_name)


# Block counts that are whole as a double, no number, absent, or in no document at all.
ODD_GRAPHS = f"""
select s.*, case doc_id % 5 when 0 then replace(assemgraph_com, concat('"nodenum":', cast(doc_id % 6 as varchar(20))), '"nodenum":2.0')
    when 1 then replace(assemgraph_com, concat('"nodenum":', cast(doc_id % 6 as varchar(20))), '"nodenum":"many"')
    when 2 then replace(assemgraph_com, concat(',"nodenum":', cast(doc_id % 6 as varchar(20))), '')
    when 3 then concat('{{"nodenum":', repeat('[', 100000)) else assemgraph_com end as odd_graph
from ({SAMPLES}) s
"""


@query(
    "odd_graphs_quarantined",
    """select doc_id, doc_id % 5 = 0 or (doc_id % 5 = 4 and doc_id % 6 > 0) as usable,
      doc_id % 5 = 0 or (doc_id % 5 = 4 and doc_id % 6 <> 1) as real_graph, doc_id % 5 in (1, 2, 3) as unreadable
    from documents""",
)
def odd_graphs_quarantined(spark, sf_dir):
    rows = bind(spark, sf_dir, ODD_GRAPHS)
    prompted = prompts.with_prompt(rows, graph="odd_graph").select("doc_id", F.col("prompt").isNotNull().alias("usable"))
    real = filters.with_real_graph(rows, "odd_graph").select("doc_id", F.lit(True).alias("real"))
    lost = filters.unreadable_graphs(rows, "odd_graph").select("doc_id", F.lit(True).alias("lost"))
    joined = prompted.join(real, "doc_id", "left").join(lost, "doc_id", "left")
    flag = [F.coalesce(old, F.lit(False)).alias(new) for old, new in (("real", "real_graph"), ("lost", "unreadable"))]
    return joined.select("doc_id", "usable", *flag)


@query(
    "prompt_quarantine",
    f"with s as ({SAMPLES}) select opts, count(*) as quarantined from s where doc_id % 6 = 0 group by opts",
)
def prompt_quarantine(spark, sf_dir):
    _, unusable = prompts.split_unusable(prompts.with_prompt(bind(spark, sf_dir, SAMPLES)))
    return unusable.groupBy("opts").agg(F.count(F.lit(1)).alias("quarantined"))


OLD_GRAPH = """concat('{"a list of cfg_blocks": ["b0", "', folder,
  '"], "edges between two connected cfg_blocks": [[0, 1]], "cfg_block count": ', doc_id % 6, '}')"""
OLD_ASSEMBLY = """concat('{"instruction set architecture": "', arch, '", "bit width": "', mode,
  '", "compiler optimization level": "', opts, '", "assembly code": "', replace(asm_ida_com, chr(10), '\\n'), '"}')"""


@query(
    "prompt_disassembly",
    f"""with s as ({SAMPLES_MORE}) select doc_id,
    {filled(templates.DISASSEMBLY_TEMPLATE, {"assembly": OLD_ASSEMBLY, "graph": OLD_GRAPH})} as prompt from s""",
)
def prompt_disassembly(spark, sf_dir):
    samples = bind(spark, sf_dir, SAMPLES)
    prompted = prompts.with_disassembly_prompt(samples, assembly="asm_ida_com", graph="assemgraph_com")
    return prompted.select("doc_id", "prompt")


SLOT_TEMPLATE = "{assembly_info}|{assembly_prompt}|{assembly_ida_con}|{cfg_prompt}|{cfg_con}|{data_mapping}"
SLOT_GRAPH = """concat('{"cfg_blocks": ["b0", "', folder, '"], "edges": [[0, 1]], "cfg_block count": ', doc_id % 6, '}')"""
SLOT_DATA = """concat('{"param": ["', folder, '", ', n_chars, '], ".rodata": ', case when doc_id % 7 = 0 then '{}'
  else concat('{"msg": "caf\\u00e9 ', lang, '"}') end, ', ".data": ',
  case when doc_id % 7 = 0 then '[]' else '[1.5, 2000.0]' end, ', ".bss": null}')"""


@query(
    "prompt_slots",
    f"""with s as ({SAMPLES_MORE}) select doc_id, {INFO_JSON} || '|' || asm_ida_com || '|' || func || '|' || {SLOT_GRAPH}
    || '|{{"cfg_blocks": ["' || func || '"], "edges": [], "cfg_block count": 1}}|' || {SLOT_DATA} as prompt from s""",
)
def prompt_slots(spark, sf_dir):
    other = F.concat(F.lit('{"nodes":["'), F.col("func"), F.lit('"],"nodenum":1}'))
    samples = bind(spark, sf_dir, SAMPLES).withColumn("assemgraph_con", other)
    return prompts.with_slot_prompt(samples, SLOT_TEMPLATE, assembly_other="func").select("doc_id", "prompt")


def bytes_of(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::int)"


def csv(values: str) -> str:
    return f"array_to_string({values}, ',')"


TOKENS = f"""
s as ({SAMPLES_MORE}),
prompted as (select doc_id, sourcecode, {prompt_sql("plain")} as prompt from s),
encoded as (select doc_id, 1 + strlen(prompt) as source_length,
   list_concat([256], list_concat({bytes_of("prompt || sourcecode")}, [257])) as whole
   from prompted where prompt is not null),
tokens as (select doc_id, source_length, whole[1:4096] as input_ids, least(len(whole), 4096) as seq_length,
   list_transform(whole[1:4096], lambda t, i: case when i <= source_length then -100 else t end) as labels
   from encoded)
"""


def _prompted(spark, sf_dir):
    """Usable prompts of the samples, spread before the per-byte work."""
    samples = spread(bind(spark, sf_dir, SAMPLES), "doc_id")
    usable, _ = prompts.split_unusable(prompts.with_prompt(samples))
    return usable


def _joined_ids(ids: pa.Array) -> pa.Array:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    # Each distinct id is rendered once.
    known = ids.flatten().dictionary_encode()
    texts = known.dictionary.cast(pa.string()).take(known.indices)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), texts), ",")
    return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string())) if ids.null_count else joined


def array_digest(name: str):
    return F.md5(pieced_function(_joined_ids, "string")(name).cast("binary")).alias(name)


@query(
    "tokenised_samples",
    f"""with {TOKENS} select doc_id, cast(source_length as int) as source_length, cast(seq_length as int) as seq_length,
    md5({csv("input_ids")}) as input_ids, md5({csv("labels")}) as labels,
    cast(len(list_filter(labels, lambda l: l = -100)) as int) as masked from tokens""",
)
def tokenised_samples(spark, sf_dir):
    rows = tokenise(_prompted(spark, sf_dir))
    return rows.select(
        "doc_id",
        "source_length",
        "seq_length",
        array_digest("input_ids"),
        array_digest("labels"),
        filters.masked_count("labels").alias("masked"),
    )


@query(
    "rows_within_label_budget",
    f"""with {TOKENS} select doc_id, cast(seq_length as int) as seq_length, md5({csv("input_ids")}) as input_ids,
    md5({csv("labels")}) as labels
    from tokens where len(list_filter(labels, lambda l: l = -100)) < 700 and seq_length > 1""",
)
def rows_within_label_budget(spark, sf_dir):
    rows = prompts.without_source_columns(training_rows(_prompted(spark, sf_dir), budget=700))
    return rows.select("doc_id", "seq_length", array_digest("input_ids"), array_digest("labels"))


# Token rows with fixed values in part of the labels, for the filters on them.
SHORT_TOKENS = f"""
short as (select row_id, part, split, seq_length, range(seq_length) as input_ids,
   list_transform(range(seq_length), lambda i: case when i < row_id % 700 then -100 else i end) as labels
   from ({LENGTHS}))
"""


def _short_tokens(spark, sf_dir):
    ids = F.sequence(F.lit(0), F.col("seq_length") - 1)
    hidden = F.col("row_id") % 700
    labels = F.transform(ids, lambda i: F.when(i < hidden, F.lit(-100)).otherwise(i))
    return bind(spark, sf_dir, LENGTHS).select("*", ids.alias("input_ids"), labels.alias("labels"))


@query(
    "trainable_lengths",
    f"with {SHORT_TOKENS} select row_id, seq_length from short where seq_length > 1 and len(input_ids) > 1",
)
def trainable_lengths(spark, sf_dir):
    return filters.trainable_length(_short_tokens(spark, sf_dir)).select("row_id", "seq_length")


@query(
    "label_budget",
    f"""with {SHORT_TOKENS} select row_id, cast(len(list_filter(labels, lambda l: l = -100)) as int) as masked from short
    where len(list_filter(labels, lambda l: l = -100)) < 250""",
)
def label_budget(spark, sf_dir):
    kept = filters.within_label_budget(_short_tokens(spark, sf_dir), budget=250)
    return kept.select("row_id", filters.masked_count("labels").alias("masked"))


@query(
    "oversize_masked_dropped",
    f"""with {SHORT_TOKENS} select row_id, seq_length from short
    where not (seq_length > 512 and len(list_filter(labels[1:512], lambda l: l <> -100)) = 0)""",
)
def oversize_masked_dropped(spark, sf_dir):
    return filters.drop_masked_oversize(_short_tokens(spark, sf_dir), PACK_LENGTH).select("row_id", "seq_length")


@query(
    "labels_all_masked",
    f"with {SHORT_TOKENS} select row_id, list_distinct(labels) = [-100] as masked from short",
)
def labels_all_masked(spark, sf_dir):
    return _short_tokens(spark, sf_dir).select("row_id", filters.all_masked("labels").alias("masked"))


def packing_sql(source: str, max_length: int, order: str = "seq_length, row_id") -> str:
    """Rule-by-rule fold over the rows of each unit in ``order``, for checking."""
    capacity = max_length * packing.BUFFER_FACTOR
    return f"""
ranked as (select *, row_number() over (partition by part, split order by {order}) as rn from {source}),
fold as (
  select part, split, rn, row_id, seq_length, cast(0 as bigint) as buffer, cast(seq_length as bigint) as held,
         cast(0 as bigint) as bin, cast(0 as bigint) as pos,
         cast(case when seq_length > {max_length} then -1 else 0 end as bigint) as open_bin,
         cast(case when seq_length > {max_length} then 0 else seq_length end as bigint) as used,
         cast(0 as bigint) as last_pos, cast(1 as bigint) as opened
  from ranked where rn = 1
  union all
  select part, split, rn, row_id, seq_length, buffer, held + seq_length,
         case when alone or not fits then opened0 else open0 end,
         case when alone or not fits then 0 else pos0 + 1 end,
         case when alone then open0 when fits then open0 else opened0 end,
         case when alone then used0 when fits then used0 + seq_length else seq_length end,
         case when alone then pos0 when fits then pos0 + 1 else 0 end,
         case when alone or not fits then opened0 + 1 else opened0 end
  from (
    select *, seq_length > {max_length} as alone, open0 >= 0 and used0 + seq_length <= {max_length} as fits from (
      select r.part, r.split, r.rn, r.row_id, r.seq_length,
             f.buffer + (case when f.held >= {capacity} then 1 else 0 end) as buffer,
             case when f.held >= {capacity} then 0 else f.held end as held,
             case when f.held >= {capacity} then -1 else f.open_bin end as open0,
             case when f.held >= {capacity} then 0 else f.used end as used0,
             case when f.held >= {capacity} then 0 else f.last_pos end as pos0,
             case when f.held >= {capacity} then 0 else f.opened end as opened0
      from fold f join ranked r on r.part = f.part and r.split = f.split and r.rn = f.rn + 1) a) b),
plan as (
  select part, split, row_id, seq_length, buffer, bin, pos,
         seq_length <= {max_length} and max(held) over (partition by part, split, buffer) >= {capacity}
         and bin = last_value(open_bin) over (partition by part, split, buffer order by rn
             rows between unbounded preceding and unbounded following) as residual
  from fold)
"""


LENGTH_PLAN = f"v as ({LENGTHS}), {packing_sql('v', PACK_LENGTH)}"


@query(
    "packing_plan",
    f"with recursive {LENGTH_PLAN} select row_id, part, split, seq_length, buffer, bin, pos, residual from plan",
)
def packing_plan(spark, sf_dir):
    return packing.plan_packing(bind(spark, sf_dir, LENGTHS), PACK_LENGTH)


STATS = """select part, split, count(*) as input_rows, count(*) filter (pos = 0) as packed_rows,
  count(*) filter (residual) as residual_rows, cast(sum(case when residual then seq_length else 0 end) as bigint) as residual_tokens,
  round(count(*) filter (pos = 0) / count(*), 6) as ratio"""


@query(
    "packing_plan_in_order",
    f"with recursive v as ({LENGTHS}), {packing_sql('v', PACK_LENGTH, 'row_id')} "
    "select row_id, part, split, seq_length, buffer, bin, pos, residual from plan",
)
def packing_plan_in_order(spark, sf_dir):
    return ordered_packing.plan_in_order(bind(spark, sf_dir, LENGTHS), PACK_LENGTH)


@query(
    "packing_statistics_in_order",
    f"""with recursive v as (select row_id, 0 as part, 0 as split, seq_length from ({LENGTHS})),
    {packing_sql('v', PACK_LENGTH, 'row_id')} {STATS} from plan group by rollup (part, split)""",
)
def packing_statistics_in_order(spark, sf_dir):
    """All rows as one unit, in the order of their ids."""
    rows = bind(spark, sf_dir, f"select row_id, 0 as part, 0 as split, seq_length from ({LENGTHS})")
    return packing.packing_stats(ordered_packing.plan_in_order(rows, PACK_LENGTH))


@query(
    "packing_statistics",
    f"with recursive {LENGTH_PLAN} {STATS} from plan group by rollup (part, split)",
)
def packing_statistics(spark, sf_dir):
    return packing.packing_stats(packing.plan_packing(bind(spark, sf_dir, LENGTHS), PACK_LENGTH))


@query(
    "packing_statistics_without_residual",
    f"""with recursive {LENGTH_PLAN}, units as ({STATS.replace("(pos = 0)", "(pos = 0 and not residual)")}
    from plan group by part, split)
    select *, cast(sum(input_rows) over (order by part, split) as bigint) as running_rows from units""",
)
def packing_statistics_without_residual(spark, sf_dir):
    plan = packing.plan_packing(bind(spark, sf_dir, LENGTHS), PACK_LENGTH)
    return packing.running_rows(packing.packing_stats(plan, keep_residual=False))


@query(
    "rows_by_length",
    f"""with v as ({LENGTHS}) select part, split, row_id, seq_length,
    row_number() over (partition by part, split order by seq_length, row_id) - 1 as place from v""",
)
def rows_by_length(spark, sf_dir):
    """The places of rows in the order in which their sorted units are written, task by task."""
    rows = packing.sort_units(bind(spark, sf_dir, LENGTHS))
    written = rows.withColumn("task", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = with_positions(cut_lineage(written, "sorted-units"), ["part", "split"], ["at"], F.col("task"), "place")
    return placed.drop("task", "at")


PACKED = f"""
{TOKENS},
kept as (select doc_id as row_id, cast(doc_id % 3 as int) as part, cast(doc_id % 2 as int) as split, seq_length,
   input_ids, labels from tokens where len(list_filter(labels, lambda l: l = -100)) < 2500),
{packing_sql("kept", 4096)},
packed as (select part, split, buffer, bin, sum(k.seq_length) as tokens,
   string_agg({csv("k.input_ids")}, ',' order by pos) as input_ids, string_agg({csv("k.labels")}, ',' order by pos) as labels
   from plan join kept k using (part, split, row_id) {{where}} group by part, split, buffer, bin)
select part, split, buffer, bin, cast(row_number() over (partition by part, split, buffer
   order by md5(concat_ws(':', '0', part, split, buffer, bin))) - 1 as int) as shuffle_pos, cast(tokens as int) as tokens, md5(input_ids) as input_ids,
   md5(labels) as labels, concat('part-', part, '-', lpad(split::varchar, 5, '0')) as shard
from packed
"""


def packed_samples(spark, sf_dir, keep_residual=True):
    """Samples to packed rows, units by document number; the tokens are stored once."""
    rows = training_rows(_prompted(spark, sf_dir)).select(
        F.col("doc_id").alias("row_id"),
        (F.col("doc_id") % 3).cast("int").alias("part"),
        (F.col("doc_id") % 2).cast("int").alias("split"),
        "input_ids",
        "labels",
        "seq_length",
    )
    return packing.pack(cut_lineage(rows, "tokens"), 4096, keep_residual=keep_residual)


def _packed_digest(packed):
    return packed.select(
        "part",
        "split",
        "buffer",
        "bin",
        "shuffle_pos",
        F.size("input_ids").alias("tokens"),
        array_digest("input_ids"),
        array_digest("labels"),
        shard_name().alias("shard"),
    )


@query("packed_rows", "with recursive " + PACKED.replace("{where}", ""))
def packed_rows(spark, sf_dir):
    return _packed_digest(packed_samples(spark, sf_dir))


@query("packed_rows_without_residual", "with recursive " + PACKED.replace("{where}", "where not residual"))
def packed_rows_without_residual(spark, sf_dir):
    return _packed_digest(packed_samples(spark, sf_dir, keep_residual=False))
