"""Sources and sinks: tables written out in a file layout and read back.

The files go to a fresh path in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.bindings import CODE, LENGTHS, RESULTS, SAMPLES, TASKS, VERDICTS, bind, load
from millrace.catalog.corpus import PACK_LENGTH, SHORT_TOKENS, array_digest, csv, packing_sql
from millrace.catalog.registry import query
from millrace.catalog.scoring import LAST_RESULT
from millrace.functions.jsontext import canonical_lines
from millrace.operators import matching, packing, scoring
from millrace.operators.latest import last_write
from millrace.session import scratch_path
from millrace.sinks import runs
from millrace.sinks import tables as sinks
from millrace.sources import jsonl, shards

# Samples as raw lines; some are blank and some are broken.
RAW_LINES = f"""
select concat('new_input_', cast(doc_id % 4 as varchar(20))) as input_folder,
       case when folder = 'src9' then '   '
            when folder = 'src4' then concat('{{"func":"', func, '", "data":')
            else concat('  {{"func":"', func, '","arch":"', arch, '","data":', data, ',"assemgraph":', assemgraph_com,
                        ',"assemgraph_com":', assemgraph_com, case when arch = 'x86' then ',"asm_obj":"nop"' else '' end,
                        '}} ') end as value
from ({SAMPLES}) s
"""


def _raw_folder(spark, sf_dir):
    path = scratch_path(spark, "lines")
    bind(spark, sf_dir, RAW_LINES).select(F.col("input_folder").alias("folder"), "value").write.partitionBy("folder").text(path)
    return path


@query(
    "canonical_samples",
    f"""with s as ({SAMPLES}), spaced as (select *,
      replace(replace(replace(replace(data, ':', ': '), ',', ', '), '1.50', '1.5'), '2e3', '2000.0') as d,
      replace(replace(assemgraph_com, ':', ': '), ',', ', ') as g from s where s.folder not in ('src9', 'src4'))
    select concat('folder=new_input_', doc_id % 4) as folder, cast(doc_id % 4 as varchar) as part,
      concat('{{"func": "', func, '", "arch": "', arch, '", "data": "', replace(d, '"', '\\"'), '", "assemgraph": "',
        replace(g, '"', '\\"'), '", "assemgraph_com": "', replace(g, '"', '\\"'),
        case when arch = 'x86' then '", "asm_obj": "nop"}}' else '", "asm_obj": ""}}' end) as canonical
    from spaced""",
)
def canonical_samples(spark, sf_dir):
    good, _ = jsonl.read_samples(spark, _raw_folder(spark, sf_dir), glob="*.txt")
    return good.select("folder", "part", "canonical")


@query(
    "rejected_lines",
    f"""with s as ({SAMPLES}) select cast(doc_id % 4 as varchar) as part, concat('{{"func":"', func, '", "data":') as rejected
    from s where s.folder = 'src4'""",
)
def rejected_lines(spark, sf_dir):
    _, bad = jsonl.read_samples(spark, _raw_folder(spark, sf_dir), glob="*.txt")
    return bad.select("part", "rejected")


# One line in five is usable; the others hold half a surrogate pair, nest too
# deeply to parse, are cut off, or are no object.
ODD_LINES = """
select doc_id, case doc_id % 5
    when 0 then concat('{"func":"f', cast(doc_id as varchar(20)), '","data":{},"asm_obj":""}')
    when 1 then concat('{"func":"f', cast(doc_id as varchar(20)), '","data":"', chr(92), 'ud800"}')
    when 2 then concat('{"func":', repeat('[', 100000))
    when 3 then concat('{"func":"f', cast(doc_id as varchar(20)))
    else concat('["f', cast(doc_id as varchar(20)), '"]') end as value
from documents
"""


@query(
    "odd_lines_sorted_out",
    """select doc_id, doc_id % 5 = 0 as usable,
    case when doc_id % 5 = 0 then concat('{"func": "f', doc_id, '", "data": "{}", "asm_obj": ""}') end as canonical,
    case doc_id % 5 when 0 then null when 1 then 28 + len(cast(doc_id as varchar)) when 2 then 100008
      when 3 then 10 + len(cast(doc_id as varchar)) else 5 + len(cast(doc_id as varchar)) end as rejected_length
    from documents""",
)
def odd_lines_sorted_out(spark, sf_dir):
    lines = bind(spark, sf_dir, ODD_LINES)
    both = canonical_lines(lines, keep=["doc_id"])
    return both.select(
        "doc_id", F.col("canonical").isNotNull().alias("usable"), "canonical", F.length("rejected").cast("bigint").alias("rejected_length")
    )


@query(
    "canonical_samples_stored",
    f"""with s as ({SAMPLES}) select concat('source=new_input_', doc_id % 4, '_a b+ü.txt') as folder, func,
      case when arch = 'x86' then 'nop' else '' end as asm_obj, arch
    from s where s.folder not in ('src9', 'src4')""",
)
def canonical_samples_stored(spark, sf_dir):
    good, _ = jsonl.read_samples(spark, _raw_folder(spark, sf_dir), glob="*.txt")
    path = scratch_path(spark, "canonical")
    named = good.select("canonical", F.regexp_replace("folder", "^folder=", "").alias("folder"), F.lit("a b+ü.txt").alias("file_name"))
    for _ in range(2):
        sinks.write_canonical(named, path)
    schema = "func string, asm_obj string, arch string, data string"
    stored = jsonl.read_typed(spark, path, schema, ["func", "asm_obj", "data"], glob="*.txt")
    return stored.select("folder", "func", "asm_obj", "arch")


def _one_file_per_row(rows, path):
    rows.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("json_array_files", f"with t as ({TASKS}) select task_id, opts, c_func from t")
def json_array_files(spark, sf_dir):
    tasks = bind(spark, sf_dir, TASKS)
    arrays = tasks.groupBy((F.col("task_id") / 100).cast("bigint").alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct("task_id", "opts", "c_func"))).alias("value")
    )
    path = _one_file_per_row(arrays.select("value"), scratch_path(spark, "arrays"))
    return jsonl.read_json_array(spark, path, "task_id bigint, opts string, c_func string")


@query("json_object_files", f"with s as ({SAMPLES}) select func as key, md5(sourcecode) as value from s")
def json_object_files(spark, sf_dir):
    samples = bind(spark, sf_dir, SAMPLES)
    objects = samples.groupBy((F.col("doc_id") / 100).cast("bigint").alias("chunk")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("func", "sourcecode")))).alias("value")
    )
    path = _one_file_per_row(objects.select("value"), scratch_path(spark, "objects"))
    return jsonl.read_json_object(spark, path, "*.txt").select("key", F.md5(F.col("value").cast("binary")).alias("value"))


@query("membership_files", f"with s as ({SAMPLES}) select mode, opts, func from s")
def membership_files(spark, sf_dir):
    samples = bind(spark, sf_dir, SAMPLES).withColumn("chunk", (F.col("doc_id") / 100).cast("bigint"))
    names = samples.groupBy("chunk", "mode", "opts").agg(F.collect_list("func").alias("names"))
    levels = names.groupBy("chunk", "mode").agg(F.map_from_entries(F.collect_list(F.struct("opts", "names"))).alias("levels"))
    nested = levels.groupBy("chunk").agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("mode", "levels")))).alias("value")
    )
    path = _one_file_per_row(nested.select("value"), scratch_path(spark, "membership"))
    return jsonl.read_membership(spark, path, "*.txt")


@query(
    "name_list_files",
    f"""with s as ({SAMPLES}) select func, cast(row_number() over (partition by doc_id // 100 order by doc_id) - 1 as int) as pos
    from s""",
)
def name_list_files(spark, sf_dir):
    samples = bind(spark, sf_dir, SAMPLES)
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "func")))
    lists = samples.groupBy((F.col("doc_id") / 100).cast("bigint").alias("chunk")).agg(ordered.alias("names"))
    literal = F.concat(F.lit("['"), F.array_join(F.transform("names", lambda n: n["func"]), "', '"), F.lit("']"))
    path = _one_file_per_row(lists.select(literal.alias("value")), scratch_path(spark, "names"))
    return jsonl.read_name_list(spark, path).select("func", "pos")


@query(
    "entity_text_files",
    """with deps as (select concat('fn', s_nationkey) as func, string_agg(s_name, chr(10) order by s_suppkey) as deps
         from supplier group by s_nationkey),
    generated as (select concat('fn', s_nationkey) as func, concat('O', s_suppkey % 4) as opts,
         string_agg('int ' || s_name, chr(10) order by s_suppkey) as gen from supplier group by s_nationkey, s_suppkey % 4)
    select g.func, d.deps, g.opts, g.gen from generated g join deps d on d.func = g.func""",
)
def entity_text_files(spark, sf_dir):
    """Suppliers as the lines of their nation's files, one file per entity (and level)."""
    func = F.concat(F.lit("fn"), F.col("s_nationkey").cast("string"))
    level = F.concat(F.lit("O"), (F.col("s_suppkey") % 4).cast("string"))
    suppliers = load(spark, sf_dir, "supplier")
    layouts = {
        "deps": (F.concat(func, F.lit("_64_deps.c")), F.col("s_name")),
        "generated": (F.concat(func, F.lit("_"), level, F.lit(".c")), F.concat(F.lit("int "), F.col("s_name"))),
    }
    paths = {}
    for name, (entity, line) in layouts.items():
        paths[name] = scratch_path(spark, name)
        lines = suppliers.select(entity.alias("entity"), "s_suppkey", line.alias("value"))
        ordered = lines.repartition("entity").sortWithinPartitions("entity", "s_suppkey").drop("s_suppkey")
        ordered.write.partitionBy("entity").text(paths[name])
    deps = jsonl.read_entity_texts(spark, paths["deps"], "_64_deps.c", text="deps", named_by="folder")
    generated = jsonl.read_level_texts(spark, paths["generated"], text="gen", named_by="folder")
    joined = matching.with_generated(deps, generated)
    return joined.select("func", F.rtrim("deps", F.lit("\n")).alias("deps"), "opts", F.rtrim("gen", F.lit("\n")).alias("gen"))


SHORT_PACKED = f"""with recursive {SHORT_TOKENS}, {packing_sql("short", PACK_LENGTH)},
packed as (select part, split, string_agg({csv(f"k.input_ids[1:{PACK_LENGTH}]")}, ',' order by pos) as input_ids,
   string_agg({csv(f"k.labels[1:{PACK_LENGTH}]")}, ',' order by pos) as labels
   from plan p join short k using (part, split, row_id)
   where not (k.seq_length > {PACK_LENGTH} and len(list_filter(k.labels[1:{PACK_LENGTH}], lambda l: l <> -100)) = 0)
   group by part, split, buffer, bin)
"""


def _packed(spark, sf_dir):
    ids = F.sequence(F.lit(0), F.col("seq_length") - 1)
    labels = F.transform(ids, lambda i: F.when(i < F.col("row_id") % 700, F.lit(-100)).otherwise(i))
    rows = bind(spark, sf_dir, LENGTHS).select("*", ids.alias("input_ids"), labels.alias("labels"))
    return packing.pack(rows, PACK_LENGTH)


@query(
    "stored_packed_rows",
    SHORT_PACKED + "select cast(part as int) as part, split, md5(input_ids) as input_ids, md5(labels) as labels from packed",
)
def stored_packed_rows(spark, sf_dir):
    path = scratch_path(spark, "packed")
    sinks.write_packed(_packed(spark, sf_dir), path)
    stored = shards.read_packed(spark, path)
    return stored.select("part", "split", array_digest("input_ids"), array_digest("labels"))


@query(
    "stored_packed_rows_of_mode",
    SHORT_PACKED + "select part, md5(input_ids) as input_ids from packed where split = 1",
)
def stored_packed_rows_of_mode(spark, sf_dir):
    path = scratch_path(spark, "packed")
    dataset = F.when(F.col("split") == 0, F.lit("train")).otherwise(F.lit("validation"))
    packed = _packed(spark, sf_dir).withColumn("dataset", dataset)
    packed.write.partitionBy("dataset").parquet(path)
    return shards.read_packed(spark, [path], mode="dev").select("part", array_digest("input_ids"))


@query(
    "stored_reports",
    f"""with v as ({VERDICTS}), runs as (select unnest(['first', 'second']) as run)
    select run, opts, round(avg(flag_run), 4) as run_rate from v cross join runs group by run, opts""",
)
def stored_reports(spark, sf_dir):
    path = scratch_path(spark, "report")
    for run in ("first", "second"):
        rates = scoring.evaluated_rates(bind(spark, sf_dir, VERDICTS)).select(
            F.lit(run).alias("run"), "opts", F.round("run_rate", 4).alias("run_rate")
        )
        sinks.append_report(rates, path)
    return spark.read.parquet(path)


@query(
    "stored_success_lists",
    f"""with v as ({VERDICTS}), passed as (select opts, event_id as item,
       row_number() over (partition by opts order by event_id) - 1 as pos from v where flag_run = 1)
    select opts, pos // 500 as chunk, string_agg(item, ',' order by pos) as items from passed group by opts, pos // 500""",
)
def stored_success_lists(spark, sf_dir):
    path = scratch_path(spark, "success")
    verdicts = bind(spark, sf_dir, VERDICTS).withColumn("item", F.col("event_id").cast("string"))
    sinks.write_success_list(scoring.success_list(verdicts, "flag_run", "event_id", "item", chunk=500), path)
    stored = spark.read.schema("opts string, chunk bigint, items array<string>").json(path)
    return stored.select("opts", "chunk", F.array_join("items", ",").alias("items"))


@query(
    "stored_generations",
    f"""with {LAST_RESULT}, t as ({TASKS}) select t.task_id, t.opts, t.c_func, l.gen as c_func_decompile
    from t join last_result l on l.task_id = t.task_id and l.opts = t.opts""",
)
def stored_generations(spark, sf_dir):
    path = scratch_path(spark, "generations")
    results = last_write(bind(spark, sf_dir, RESULTS), ["task_id", "opts"], ["file_name", "line_no"])
    generated = results.select("task_id", "opts", F.col("gen").alias("c_func_decompile"))
    sinks.append_generated(bind(spark, sf_dir, TASKS), generated, ["task_id", "opts"], path)
    return spark.read.schema("task_id bigint, opts string, c_func string, c_func_decompile string").json(path)


@query(
    "generations_of_repeated_runs",
    f"""with {LAST_RESULT}, t as ({TASKS}), joined as (select t.task_id, t.opts, t.c_func, l.gen as c_func_decompile
    from t left join last_result l on l.task_id = t.task_id and l.opts = t.opts and t.task_id % 3 <> 0)
    select *, c_func_decompile is not null as generated from joined""",
)
def generations_of_repeated_runs(spark, sf_dir):
    """Two runs, one of them three times, and the inputs that no text was generated for."""
    path = scratch_path(spark, "generation-runs")
    results = last_write(bind(spark, sf_dir, RESULTS), ["task_id", "opts"], ["file_name", "line_no"])
    generated = results.select("task_id", "opts", F.col("gen").alias("c_func_decompile")).filter("task_id % 3 <> 0")
    tasks = bind(spark, sf_dir, TASKS).select("task_id", "opts", "c_func")
    missing = {}
    for run, rest in (("even", 0), ("odd", 1), ("even", 0), ("even", 0)):
        asked = tasks.filter(f"task_id % 2 = {rest}")
        missing[run] = runs.append_generated_run(asked, generated, ["task_id", "opts"], path, run)
    stored = runs.read_runs(spark, path, "task_id bigint, opts string, c_func string, c_func_decompile string")
    found = stored.withColumn("generated", F.lit(True))
    for left in missing.values():
        found = found.unionByName(left.withColumn("generated", F.lit(False)), allowMissingColumns=True)
    return found


@query(
    "stored_stage_texts",
    f"with c as ({CODE}) select func, opts, md5(c_test || chr(10) || c_func) as text from c",
)
def stored_stage_texts(spark, sf_dir):
    path = scratch_path(spark, "stages")
    code = bind(spark, sf_dir, CODE)
    combined = F.concat(F.col("c_test"), F.lit("\n"), F.col("c_func"))
    stages = code.select(
        "func",
        "opts",
        F.inline(
            F.array(
                F.struct(F.lit("original").alias("stage"), F.col("gen").alias("text")),
                F.struct(F.lit("combined").alias("stage"), combined.alias("text")),
            )
        ),
    )
    sinks.write_stage_texts(stages, path)
    stored = sinks.read_stage_texts(spark, path, "combined")
    return stored.select("func", "opts", F.md5(F.col("text").cast("binary")).alias("text"))
