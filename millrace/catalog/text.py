"""Cleaning of generated text and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.bindings import CODE, SAMPLES, bind
from millrace.catalog.registry import query
from millrace.functions import text
from millrace.functions.codescan import target_function
from millrace.functions.jsontext import data_mapping, graph_mapping, python_json, same_output, wrap_strings
from millrace.operators import filters
from millrace.operators.ordered import id_bucket, spread, with_positions

# The stripped characters as a DuckDB string literal.
SPACES = "'" + text.WHITESPACE + "'"
PATTERN = "'[a-zA-Z0-9_]{2,} *[(]'"


def _digest(name: str):
    return F.md5(F.col(name).cast("binary")).alias(name)


def _code(spark, sf_dir):
    """Programs and answers, spread for the work on whole texts."""
    return spread(bind(spark, sf_dir, CODE), "doc_id")


def fence(column: str, body: str) -> str:
    pattern = f"'```[^\\n]*\\n({body})```'"
    return f"""trim(case when regexp_matches({column}, {pattern}) then regexp_extract({column}, {pattern}, 1)
      else {column} end, {SPACES})"""


FIRST = fence("gen", "[\\s\\S]*?")
LAST = fence("gen", "[\\s\\S]*")


@query(
    "fenced_code",
    f"""with c as ({CODE}) select doc_id, md5({FIRST}) as first_fence, md5({LAST}) as to_last_fence,
    md5(replace(replace(gen, '```c', ''), '```', '')) as marks_removed from c""",
)
def fenced_code(spark, sf_dir):
    rows = _code(spark, sf_dir).select(
        "doc_id",
        text.fenced_code("gen").alias("first_fence"),
        text.fenced_code("gen", greedy=True).alias("to_last_fence"),
        text.without_fence_marks("gen").alias("marks_removed"),
    )
    return rows.select("doc_id", *[_digest(c) for c in rows.columns[1:]])


@query(
    "calling_conventions_removed",
    f"""with c as ({CODE}) select doc_id,
    md5(replace(replace({LAST}, ' __fastcall ', ' '), ' __cdecl ', ' ')) as spaced,
    md5(replace(replace(replace({FIRST}, '__fastcall', ''), '__cdecl', ''), '__usercall', '')) as bare from c""",
)
def calling_conventions_removed(spark, sf_dir):
    rows = _code(spark, sf_dir).select(
        "doc_id",
        text.without_conventions(text.fenced_code("gen", greedy=True), spaced=True).alias("spaced"),
        text.without_conventions(text.fenced_code("gen")).alias("bare"),
    )
    return rows.select("doc_id", _digest("spaced"), _digest("bare"))


def _eight_times(line: str) -> str:
    for _ in range(8):
        line = f"regexp_replace({line}, {PATTERN}, chr(1))"
    return f"replace({line}, chr(1), ' func0(')"


@query(
    "first_function_renamed",
    f"""with c as ({CODE}), split as (select doc_id, c_func, string_split({FIRST}, chr(10)) as ls from c),
    aimed as (select *, coalesce(list_position(list_transform(ls, lambda x:
       not (contains(x, '#include') and contains(c_func, x)) and regexp_matches(x, {PATTERN})), true), 0) as target
       from split)
    select doc_id, md5(array_to_string(list_transform(ls, lambda x, i:
       case when i = target then {_eight_times("x")}
            when (target = 0 or i < target) and contains(x, '#include') and contains(c_func, x) then ''
            else x end), chr(10))) as renamed
    from aimed""",
)
def first_function_renamed(spark, sf_dir):
    rows = _code(spark, sf_dir).withColumn("decom", text.fenced_code("gen"))
    renamed = rows.select("doc_id", text.rename_first_function("decom", "c_func", calls=8).alias("renamed"))
    return renamed.select("doc_id", _digest("renamed"))


@query(
    "includes_hoisted",
    f"""with c as ({CODE}), lined as (select *,
      list_filter(string_split(c_func, chr(10)), lambda x: contains(x, '#include')) as a,
      list_filter(string_split(c_test, chr(10)), lambda x: contains(x, '#include')) as b from c),
    moved as (select doc_id, gen, array_to_string(list_concat(a, b), chr(10)) || chr(10) as header,
      list_reduce(list_prepend(c_test, b), lambda x, y: replace(x, y, '')) as rest from lined)
    select doc_id, md5(header || chr(10) || gen || chr(10) || rest) as program, md5(header || chr(10) || gen) as bare
    from moved""",
)
def includes_hoisted(spark, sf_dir):
    program, bare = text.combined_program("c_func", "c_test", "gen")
    rows = _code(spark, sf_dir).select("doc_id", program.alias("program"), bare.alias("bare"))
    return rows.select("doc_id", _digest("program"), _digest("bare"))


@query(
    "dependencies_joined",
    f"with c as ({CODE}) select doc_id, md5(c_test || chr(10) || c_func) as program from c",
)
def dependencies_joined(spark, sf_dir):
    rows = _code(spark, sf_dir)
    return rows.select("doc_id", text.with_dependencies("c_test", "c_func").alias("program")).select("doc_id", _digest("program"))


@query(
    "lines_mentioning_function",
    f"""with c as ({CODE}), split as (
      select doc_id, opts, func, c_func || chr(10) || c_test as program, gen from c),
    kept as (select *, string_split(program, chr(10)) as ls from split)
    select doc_id, opts, array_to_string(list_filter(list_transform(ls, lambda x, i:
      x || case when i = len(ls) then '' else chr(10) end), lambda x: contains(x, func)), '') as decom
    from kept""",
)
def lines_mentioning_function(spark, sf_dir):
    rows = _code(spark, sf_dir).withColumn("program", text.with_dependencies("c_func", "c_test"))
    return rows.select("doc_id", "opts", text.lines_mentioning("program", "func").alias("decom"))


@query(
    "first_nonempty_text",
    f"""with c as ({CODE}), picked as (
      select doc_id, coalesce(nullif(case when contains(gen, func) then gen end, ''),
                              nullif(case when doc_id % 10 = 0 then '' else c_func end, '')) as decom from c)
    select doc_id, md5(decom) as decom from picked where decom is not null""",
)
def first_nonempty_text(spark, sf_dir):
    rows = _code(spark, sf_dir)
    mentioned = F.when(F.contains("gen", "func"), F.col("gen"))
    fallback = F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("c_func"))
    picked = rows.select("doc_id", text.first_nonempty(mentioned, fallback).alias("decom"))
    return filters.present(picked, "decom").select("doc_id", _digest("decom"))


@query(
    "wrapper_repointed",
    f"""with c as ({CODE}) select doc_id,
    md5(regexp_replace(wrapper, '(extern "C" \\n[{{]\\n#include ")[^\\n]*?("\\n[}}])', '\\1/work/f.c\\2')) as wrapper
    from c""",
)
def wrapper_repointed(spark, sf_dir):
    rows = _code(spark, sf_dir).select("doc_id", text.repoint_include("wrapper", "/work/f.c").alias("wrapper"))
    return rows.select("doc_id", _digest("wrapper"))


@query(
    "optimized_code_applied",
    f"""with c as ({CODE}), code as (select doc_id, c_func, regexp_extract(
        regexp_extract(answer, '(?i)# optimized code *\\n([^#]*)#', 1), '(?i)```c\\n([\\s\\S]*)```', 1) as code from c)
    select doc_id, code, md5(case when code <> '' and not contains(code, 'none') then code else c_func end) as kept
    from code""",
)
def optimized_code_applied(spark, sf_dir):
    rows = _code(spark, sf_dir).select(
        "doc_id", text.optimized_code("answer").alias("code"), text.apply_optimized("answer", "c_func").alias("kept")
    )
    return rows.select("doc_id", "code", _digest("kept"))


def renamed_call(text_sql: str, name: str) -> str:
    """SQL for pointing calls of ``name`` at its renamed double; no two calls touch here."""
    return f"regexp_replace({text_sql}, '(^|[^a-zA-Z0-9_]){name} *[(]', '\\1{name}__bench(', 'g')"


@query(
    "conflicts_renamed",
    f"with c as ({CODE}) select doc_id, md5({renamed_call(renamed_call('gen', 'g2'), 'g7')}) as renamed from c",
)
def conflicts_renamed(spark, sf_dir):
    rows = _code(spark, sf_dir)
    dependencies = F.concat(F.lit("static int g2__bench (int x) {\n}\nint g7__bench(void) {\n}\n"), F.col("c_test"))
    return rows.select("doc_id", F.md5(text.rename_conflicts(dependencies, "gen")).alias("renamed"))


FUNCTION = "' fn' || doc_id || '(int x) { return g1 (x)+g2(x)+g3(x)+g4(x)+g5(x)+g6(x)+g7(x)+g8(x)+g9(x); }'"


@query(
    "target_functions",
    f"""with c as ({CODE}) select doc_id,
      md5(case when contains(gen, '```') then 'int __fastcall' || {FUNCTION} else '' end) as text,
      contains(gen, '```') as renamed, cast(case when contains(gen, '```') then 1 else 0 end as int) as candidates
    from c""",
)
def target_functions(spark, sf_dir):
    rows = _code(spark, sf_dir).withColumn("decom", text.fenced_code("gen"))
    chosen = rows.select("doc_id", target_function("decom", "func").alias("chosen"))
    return chosen.select("doc_id", F.md5("chosen.text").alias("text"), "chosen.renamed", "chosen.candidates")


# Two rivals, a helper, numbers set in one declaration, and on every third row an
# opening that is never closed.
RIVALS = """
select doc_id, concat('int n = ', cast(doc_id as varchar(20)), ', m = 4, *p;', chr(10), 'int helper(int x) { return x; }', chr(10),
  'int first(int x) { return helper(x); }', chr(10), 'long second(void) { if (1) { return 2; } return 0; }', chr(10),
  case when doc_id % 3 = 0 then 'int broken(int x) { ((((' else '' end) as code
from documents
"""


@query(
    "target_functions_among_rivals",
    f"""with c as ({RIVALS}), declared as (select doc_id, concat('int n = ', doc_id, ', m = 4, *p;', chr(10)) as d from c)
    select doc_id, md5(d || 'long f(void) {{ if (1) {{ return 2; }} return 0; }}') as last,
      md5(d || 'long f(void) {{ if (1) {{ return 2; }} return 0; }}') as longest, cast(2 as int) as candidates
    from declared""",
)
def target_functions_among_rivals(spark, sf_dir):
    rows = bind(spark, sf_dir, RIVALS).withColumn("name", F.lit("f"))
    picked = [target_function("code", "name", pick).alias(pick) for pick in ("last", "longest")]
    chosen = rows.select("doc_id", *picked)
    return chosen.select("doc_id", *[F.md5(f"{p}.text").alias(p) for p in ("last", "longest")], "last.candidates")


@query(
    "file_name_keys",
    f"""with s as ({SAMPLES}) select doc_id, regexp_replace(func || '_3.jsonl', '[^0-9]', '', 'g') as digits,
    replace(substr(func || '_3.jsonl', 5), '.jsonl', '') as key, concat_ws('_', func, opts) as target from s""",
)
def file_name_keys(spark, sf_dir):
    name = F.concat(F.col("func"), F.lit("_3.jsonl"))
    return bind(spark, sf_dir, SAMPLES).select(
        "doc_id",
        text.digits_of(name).alias("digits"),
        text.file_key(name).alias("key"),
        text.composite_id("func", "opts").alias("target"),
    )


@query("samples_of_bit_width", f"with s as ({SAMPLES}) select doc_id, mode, opts from s where mode = '64'")
def samples_of_bit_width(spark, sf_dir):
    return filters.by_bit_width(bind(spark, sf_dir, SAMPLES), "64").select("doc_id", "mode", "opts")


@query("samples_with_real_graph", f"with s as ({SAMPLES}) select doc_id from s where doc_id % 6 <> 1")
def samples_with_real_graph(spark, sf_dir):
    return filters.with_real_graph(bind(spark, sf_dir, SAMPLES), "assemgraph_com").select("doc_id")


@query(
    "samples_with_real_data",
    f"""with s as ({SAMPLES}) select doc_id from s
    where not (json_extract(data, '$.".rodata"') in ('{{}}', '[]', 'null') and json_extract(data, '$.".data"') in ('{{}}', '[]', 'null'))""",
)
def samples_with_real_data(spark, sf_dir):
    return filters.with_real_data(bind(spark, sf_dir, SAMPLES)).select("doc_id")


@query(
    "functions_in_position_range",
    f"""with s as ({SAMPLES}), numbered as (select doc_id, func, row_number() over (order by doc_id) - 1 as pos from s)
    select * from numbered where pos >= 100 and pos < least(100 + 300, 5000)""",
)
def functions_in_position_range(spark, sf_dir):
    names = bind(spark, sf_dir, SAMPLES).select("doc_id", "func")
    numbered = with_positions(names, [], ["doc_id"], id_bucket("doc_id"))
    return filters.position_range(numbered, start=1, count=3)


@query(
    "generations_present",
    f"""with c as ({CODE}) select opts, count(*) as kept from c where contains(gen, '```') group by opts""",
)
def generations_present(spark, sf_dir):
    rows = _code(spark, sf_dir).withColumn(
        "gen", F.when(F.contains("gen", F.lit(text.FENCE)), F.col("gen")).otherwise("")
    )
    kept, _ = filters.generated_only(rows, "gen")
    return kept.groupBy("opts").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "generations_missing",
    f"""with c as ({CODE}) select opts, count(*) filter (not contains(gen, '```')) as skipped
    from c group by opts""",
)
def generations_missing(spark, sf_dir):
    rows = _code(spark, sf_dir).withColumn(
        "gen", F.when(F.contains("gen", F.lit(text.FENCE)), F.col("gen")).otherwise("")
    )
    _, skipped = filters.generated_only(rows, "gen")
    return skipped


DATA_JSON = """concat('{"stack variables (size and relative offset)": ["', folder, '", ', n_chars,
  '], "read-only constants (size and value)": ', case when doc_id % 7 = 0 then '{}'
    else concat('{"msg": "caf\\u00e9 ', lang, '"}') end,
  ', "initialized global/static data (size and initial value)": ', case when doc_id % 7 = 0 then '[]' else '[1.5, 2000.0]' end,
  ', "uninitialized global/static data (size and count)": null}')"""
GRAPH_JSON = """concat('{"cfg_blocks (names and corresponding instructions)": ["b0", "', folder,
  '"], "edges between two connected cfg_blocks": [[0, 1]], "cfg_block count": ', doc_id % 6, '}')"""
SAMPLES_MORE = SAMPLES.replace("text as sourcecode,", "text as sourcecode, n_chars, lang,")


@query(
    "prompt_json_columns",
    f"""with s as ({SAMPLES_MORE}) select doc_id, {DATA_JSON} as data_mapping, {GRAPH_JSON} as graph_mapping,
    replace(replace(replace(replace(replace(data, ':', ': '), ',', ', '), '1.50', '1.5'), '2e3', '2000.0'), 'é', '\\u00e9')
      as escaped,
    replace(replace(replace(replace(data, ':', ': '), ',', ', '), '1.50', '1.5'), '2e3', '2000.0') as stored
    from s""",
)
def prompt_json_columns(spark, sf_dir):
    return bind(spark, sf_dir, SAMPLES).select(
        "doc_id",
        data_mapping("data").alias("data_mapping"),
        graph_mapping("assemgraph_com").alias("graph_mapping"),
        python_json("data").alias("escaped"),
        python_json("data", ascii_only=False).alias("stored"),
    )


@query(
    "wrapped_string_values",
    """select event_id, case when event_id % 4 = 0 then '{}'
      when event_id % 4 = 1 then concat('{"a": ["', event_type, '"], "b": [1]}') end as wrapped from events""",
)
def wrapped_string_values(spark, sf_dir):
    flat = bind(
        spark,
        sf_dir,
        """select event_id, case when event_id % 4 = 0 then '{}'
             when event_id % 4 = 1 then concat('{"a":"', event_type, '","b":[1]}')
             else props end as flat from events""",
    )
    return flat.select("event_id", wrap_strings("flat").alias("wrapped"))


@query(
    "observed_outputs_equal",
    """select event_id, case when event_id % 5 = 0 then true when event_id % 5 = 1 then false
      when event_id % 5 = 2 then true when event_id % 5 = 3 then false else true end as equal from events""",
)
def observed_outputs_equal(spark, sf_dir):
    pairs = bind(
        spark,
        sf_dir,
        """select event_id,
             case event_id % 5 when 0 then props when 1 then '{"k":1.0}' when 2 then '{}'
               when 3 then concat('[', props, ',1]') else '{"k":0.30000000000000004,"l":[true]}' end as observed,
             case event_id % 5 when 0 then props when 1 then '{"k":1}' when 2 then props
               when 3 then concat('[', props, ']') else '{"k":0.3,"l":[true],"m":2}' end as expected
           from events""",
    )
    return pairs.select("event_id", same_output("observed", "expected").alias("equal"))
