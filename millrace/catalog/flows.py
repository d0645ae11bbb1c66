"""End-to-end evaluation and corpus flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.bindings import CODE, RESULTS, bind
from millrace.catalog.corpus import array_digest, bytes_of, csv, filled, packing_sql
from millrace.catalog.registry import query
from millrace.catalog.scoring import LEVELS
from millrace.catalog.text import FIRST, FUNCTION, PATTERN
from millrace.functions.templates import TEMPLATES
from millrace.operators.ordered import spread
from millrace.plans import corpus, evaluation
from millrace.session import scratch_path
from millrace.sinks.tables import write_merged
from millrace.sources.shards import read_packed

# Conversations as answers of functions: a function is a conversation.
ANSWERS = """
select concat('func', cast(conv_id as varchar(20))) as func, concat('O', cast(turn % 4 as varchar(20))) as opts,
       case when conv_id % 3 = 0 then '32' else '64' end as mode,
       concat('f', cast(turn % 3 as varchar(20))) as file_name, turn as line_no,
       concat('{"nodenum":', cast(1 + conv_id % 3 as varchar(20)), '}') as assemgraph,
       case when conv_id % 5 = 0 then '{".rodata":{},".data":[]}' else '{".rodata":{"a":1},".data":[]}' end as data,
       {plain} as sourcecode,
       concat('```c', chr(10), replace({plain}, 'e', ''), chr(10), '```') as gen,
       concat('int __cdecl ', {plain}) as pscode
from conversations
"""


def answers(dialect: str) -> str:
    flag = ", 'g'" if dialect == "duckdb" else ""
    return ANSWERS.replace("{plain}", f"regexp_replace(text, concat('[^ -~', chr(10), ']'), '?'{flag})")


def _similarity_oracle(where: str, decom: str) -> str:
    return f"""with a as ({answers("duckdb")}),
    last_answer as (select * from (select *, row_number() over (partition by func, opts order by file_name desc, line_no desc)
      as rn from a where mode = '64' and {where}) where rn = 1),
    cleaned as (select *, {decom} as decom from last_answer),
    scored as (select opts, case when length(decom) = 0 then 0.0
        else greatest(0.0, 1.0 - levenshtein(sourcecode, decom)::double / length(decom)) end as similarity from cleaned)
    select l.opts, round(coalesce(avg(similarity), 0), 6) as mean_similarity
    from {LEVELS.replace("levels(", "l(")} left join scored s on s.opts = l.opts group by l.opts"""


def _similarity(spark, sf_dir, **options):
    rows = spread(bind(spark, sf_dir, answers("spark")), "func", "opts")
    means = evaluation.answer_similarity(rows, "64", **options)
    return means.select("opts", F.round("mean_similarity", 6).alias("mean_similarity"))


@query(
    "answer_similarity_on_real_code",
    _similarity_oracle("assemgraph <> '{\"nodenum\":1}' and data <> '{\".rodata\":{},\".data\":[]}'", FIRST),
)
def answer_similarity_on_real_code(spark, sf_dir):
    return _similarity(spark, sf_dir, real_graph=True, real_data=True)


@query(
    "pseudo_code_similarity",
    _similarity_oracle("true", f"replace({FIRST.replace('gen', 'pscode')}, '__cdecl', '')"),
)
def pseudo_code_similarity(spark, sf_dir):
    return _similarity(spark, sf_dir, pseudo_code=True)


MENTIONS = """
select concat('func', cast(conv_id as varchar(20))) as func, concat('O', cast(turn as varchar(20))) as opts,
       concat('/* ', role, ' */', chr(10), case when turn % 2 = 0 then concat('int func', cast(conv_id as varchar(20)), '() {')
              else 'int other() {' end, {plain}, chr(10), '}') as text,
       {plain} as spare, turn, role
from conversations
"""


def mentions(dialect: str) -> str:
    flag = ", 'g'" if dialect == "duckdb" else ""
    return MENTIONS.replace("{plain}", f"regexp_replace(text, '[^ -~]', '?'{flag})")


@query(
    "function_similarity_by_level",
    f"""with m as ({mentions("duckdb")}),
    sources as (select func, spare as sourcecode from m where turn = 0),
    lined as (select m.func, m.opts, s.sourcecode, m.spare, m.role,
        list_filter(list_transform(string_split(m.text, chr(10)), lambda x, i: x || case when i = len(string_split(m.text, chr(10)))
           then '' else chr(10) end), lambda x: contains(x, m.func)) as kept
      from m join sources s on s.func = m.func where m.role <> 'system'),
    chosen as (select func, opts, sourcecode, coalesce(nullif(array_to_string(kept, ''), ''),
        nullif(case when role = 'assistant' then spare end, '')) as decom from lined)
    select opts, count(*) as functions, round(avg(case when similarity <> 0 then similarity end), 6) as mean_similarity from (
      select opts, greatest(0.0, 1.0 - levenshtein(sourcecode, decom)::double / length(decom)) as similarity
      from chosen where decom is not null) group by opts""",
)
def function_similarity_by_level(spark, sf_dir):
    rows = spread(bind(spark, sf_dir, mentions("spark")), "func", "opts")
    sources = rows.filter("turn = 0").select("func", F.col("spare").alias("sourcecode"))
    fallback = rows.filter("role = 'assistant'").select("func", "opts", F.col("spare").alias("text"))
    members = rows.filter("role <> 'system'").select("func", "opts")
    scored = evaluation.function_similarity(sources, rows.select("func", "opts", "text"), fallback, members)
    value = F.when(F.col("similarity") != 0, F.col("similarity"))
    return scored.groupBy("opts").agg(
        F.count(F.lit(1)).alias("functions"), F.round(F.avg(value), 6).alias("mean_similarity")
    )


PROGRAM_RESULTS = f"select c.task_id, c.sample, c.opts, c.file_name, c.line_no, c.gen, '64' as mode from ({RESULTS}) c"
PROGRAM_TASKS = """
select n_nationkey as task_id, concat('O', cast(n_nationkey % 4 as varchar(20))) as opts,
       concat('#include <a.h>', chr(10), 'int ', n_name, '(int x);') as c_func,
       concat('#include <b.h>', chr(10), 'int main() {}') as c_test
from nation
"""


@query(
    "programs_by_sample",
    f"""with r as ({RESULTS}), t as ({PROGRAM_TASKS}), s as (select unnest(range(20)) as sample),
    last_result as (select * from (select *, row_number() over (
      partition by task_id, sample, opts order by file_name desc, line_no desc) as rn from r) where rn = 1),
    joined as (select t.*, s.sample, l.gen from t cross join s join last_result l
      on l.task_id = t.task_id and l.opts = t.opts and l.sample = s.sample),
    cleaned as (select *, regexp_replace(trim(regexp_extract(gen, '```[^\\n]*\\n([\\s\\S]*?)```', 1), chr(10)), {PATTERN}, ' func0(')
      as decom from joined)
    select task_id, cast(sample as int) as sample, opts, concat_ws('_', task_id, sample, opts) as result_id,
      '#include <a.h>' || chr(10) || '#include <b.h>' || chr(10) || chr(10) || decom as bare,
      '#include <a.h>' || chr(10) || '#include <b.h>' || chr(10) || chr(10) || decom || chr(10) || chr(10) || 'int main() {{}}'
      as program
    from cleaned""",
)
def programs_by_sample(spark, sf_dir):
    return evaluation.task_programs(
        bind(spark, sf_dir, PROGRAM_TASKS), bind(spark, sf_dir, PROGRAM_RESULTS), "64", samples=20, on_missing="skip", renamed_calls=8
    )


# Lines of one file for each task, stored merged, some cut off; later lines of a level replace earlier ones.
RESULT_LINES = """
select user_id as task_id, event_id, case when event_id % 17 = 0 then '{"opts":'
  else concat('{"opts":"', case event_type when 'click' then 'O0' when 'error' then 'O1' when 'purchase' then 'O2' else 'O3' end,
    '","mode":"', case when event_id % 5 = 0 then '32' else '64' end, '","c_func_decompile":"```c', chr(92), 'nint gen(int x) { return ',
    cast(event_id as varchar(20)), '; }', chr(92), 'n```"}') end as value
from events
"""


@query(
    "rates_from_result_files",
    f"""with t as ({PROGRAM_TASKS}), r as (select user_id as task_id, event_id,
      case event_type when 'click' then 'O0' when 'error' then 'O1' when 'purchase' then 'O2' else 'O3' end as opts
      from events where event_id % 17 <> 0 and event_id % 5 <> 0),
    last as (select task_id, opts, cast(max(event_id) as varchar) as id from r group by task_id, opts),
    v as (select t.opts, contains(id, '7') as c, contains(id, '7') and contains(id, '3') as u from t join last using (task_id, opts)),
    rates as (select l.opts, coalesce(count(*) filter (c), 0) / 6.0 as compile_rate, coalesce(count(*) filter (u), 0) / 6.0 as run_rate
      from (select concat('O', unnest(range(4))) as opts) l left join v on v.opts = l.opts group by l.opts)
    select opts, compile_rate, run_rate,
      printf('64 bits opt:%s compile_rate:%.4f run_rate:%.4f', opts, compile_rate, run_rate) as line from rates""",
)
def rates_from_result_files(spark, sf_dir):
    path = scratch_path(spark, "results")
    name = F.concat(F.lit("func"), F.col("task_id"), F.lit(".jsonl")).alias("name")
    write_merged(bind(spark, sf_dir, RESULT_LINES).select("value", "event_id", name), path, "name", ["event_id"])

    def judge(programs):
        seven, three = (F.contains("program", F.lit(digit)) for digit in "73")
        return programs.select("opts", seven.cast("int").alias("flag_compile"), (seven & three).cast("int").alias("flag_run"))

    tasks = bind(spark, sf_dir, PROGRAM_TASKS)
    return evaluation.evaluate_files(tasks, path, judge, "64", "64 bits", "*.txt", on_missing="skip", merged=True)


@query(
    "programs_with_dependencies",
    f"""with c as ({CODE}) select func, opts, contains(gen, '```') as renamed,
      case when contains(gen, '```') then md5('int g1__bench(int x) {{' || chr(10) || '}}' || chr(10) || c_test || chr(10)
        || 'int' || replace({FUNCTION}, 'g1 (', 'g1__bench(')) end as program
    from c""",
)
def programs_with_dependencies(spark, sf_dir):
    code = spread(bind(spark, sf_dir, CODE), "doc_id").withColumn("mode", F.lit("64"))
    deps = F.concat(F.lit("int g1__bench(int x) {\n}\n"), F.col("c_test"))
    names = code.select("func", deps.alias("deps"))
    programs, _ = evaluation.function_programs(names, code.select("func", "opts", "mode", "gen"), "64", pseudo_code=True)
    return programs.select("func", "opts", "renamed", F.md5("program").alias("program"))


@query(
    "run_verdicts_from_outputs",
    """select concat('fn', event_id) as func, concat('O', event_id % 4) as opts,
      case when event_id % 3 = 0 then 1 when event_id % 3 = 1 then 0 else 1 end as flag_run from events""",
)
def run_verdicts_from_outputs(spark, sf_dir):
    rows = bind(
        spark,
        sf_dir,
        """select concat('fn', cast(event_id as string)) as func, concat('O', cast(event_id % 4 as string)) as opts, props,
             case event_id % 3 when 0 then props when 1 then concat('[', props, ']') else '{}' end as observed from events""",
    )
    expected = rows.select("func", F.col("props").alias("expected"))
    return evaluation.output_verdicts(rows.select("func", "opts", "observed"), expected)


CORPUS_LENGTH, CORPUS_BUDGET = 2048, 1500
CORPUS_SLOTS = {
    "assembly": "'call ' || source",
    "data": """concat('{"stack variables (size and relative offset)": [', n_chars, '], "read-only constants (size and value)": "',
      lang, '", "initialized global/static data (size and initial value)": [1], ',
      '"uninitialized global/static data (size and count)": 0}')""",
    "graph": """concat('{"cfg_blocks (names and corresponding instructions)": ["b0"], ',
      '"edges between two connected cfg_blocks": [[0, 1]], "cfg_block count": ', doc_id % 3, '}')""",
}
CORPUS_PROMPT = " ".join(
    f"when doc_id % 3 = {blocks} then {filled(template, CORPUS_SLOTS)}"
    for blocks, template in zip((1, 2), TEMPLATES["plain"])
)


@query(
    "corpus_from_raw_lines",
    f"""with recursive placed as (select *, row_number() over (order by source, doc_id) - 1 as row_id, count(*) over () as n
      from documents),
    prompted as (select row_id, 0 as part, case when round_even(n * 50 / 100.0::double, 0) <= row_id then 1 else 0 end as split,
      text, case {CORPUS_PROMPT} end as prompt from placed),
    encoded as (select *, 1 + strlen(prompt) as hidden,
      list_concat([256], list_concat({bytes_of("prompt || text")}, [257])) as whole from prompted where prompt is not null),
    kept as (select part, split, row_id, whole[1:{CORPUS_LENGTH}] as input_ids, least(len(whole), {CORPUS_LENGTH}) as seq_length,
      list_transform(whole[1:{CORPUS_LENGTH}], lambda t, i: case when i <= hidden then -100 else t end) as labels
      from encoded where least(hidden, {CORPUS_LENGTH}) < {CORPUS_BUDGET}),
    {packing_sql("kept", CORPUS_LENGTH)}
    select part, split, buffer, bin, cast(sum(k.seq_length) as int) as tokens,
      md5(string_agg({csv("k.input_ids")}, ',' order by pos)) as input_ids,
      md5(string_agg({csv("k.labels")}, ',' order by pos)) as labels
    from plan join kept k using (part, split, row_id) group by part, split, buffer, bin""",
)
def corpus_from_raw_lines(spark, sf_dir):
    """The whole way from raw lines, one folder per source, to stored packed rows."""
    path, target = scratch_path(spark, "raw"), scratch_path(spark, "corpus")
    lines = bind(
        spark,
        sf_dir,
        """select source, doc_id,
             to_json(named_struct('func', concat('func', cast(doc_id as string)), 'arch', 'x86', 'mode', '64',
             'opts', 'O1', 'sourcecode', text, 'asm_ida_com', concat('call ', source),
             'data', named_struct('param', array(n_chars), '.rodata', lang, '.data', array(1), '.bss', 0),
             'assemgraph_com', named_struct('nodes', array('b0'), 'edges', array(array(0, 1)), 'nodenum', doc_id % 3))) as value
           from documents""",
    )
    # Files in document order, so that file and line order is source and document order.
    ordered = lines.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id").drop("doc_id")
    ordered.write.partitionBy("source").text(path)
    corpus.prepare_corpus(
        spark, path, target, num_parts=1, bins=2, max_length=CORPUS_LENGTH, budget=CORPUS_BUDGET, glob="*.txt"
    )
    packed = read_packed(spark, f"{target}/packed")
    tokens = F.size("input_ids").alias("tokens")
    return packed.select("part", "split", "buffer", "bin", tokens, array_digest("input_ids"), array_digest("labels"))
