"""Rates, pass@k, similarity, matching and leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.bindings import RESULTS, SAMPLES, TASKS, VERDICTS, answers, bind, load
from millrace.catalog.registry import query
from millrace.functions.similarity import edit_distance, edit_similarity
from millrace.functions.text import composite_id, fenced_code, without_conventions
from millrace.operators import filters, matching, scoring
from millrace.operators.latest import last_write
from millrace.operators.ordered import spread
from millrace.operators.reports import leaderboard
from millrace.sinks.tables import report_lines

LEVELS = "(values ('O0'), ('O1'), ('O2'), ('O3')) levels(opts)"
COUNTS = f"""
v as ({VERDICTS}),
counts as (select task_id, opts, count(*) as n, cast(sum(flag_run) as bigint) as c from v group by task_id, opts)
"""


def _pass(k: int) -> str:
    return f"""(case when n - c < {k} then 1.0 when c = 0 then 0.0
        else 1.0 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::double - {k}::double / i))
        end)"""


@query("correct_counts", f"with {COUNTS} select * from counts")
def correct_counts(spark, sf_dir):
    return scoring.correct_counts(bind(spark, sf_dir, VERDICTS))


@query(
    "pass_at_k_by_task",
    f"with {COUNTS} select task_id, opts, n, c, round({_pass(1)}, 6) as pass_at_1, "
    f"round({_pass(10)}, 6) as pass_at_10 from counts",
)
def pass_at_k_by_task(spark, sf_dir):
    scored = scoring.task_pass_at_k(bind(spark, sf_dir, VERDICTS))
    rounded = [F.round(name, 6).alias(name) for name in ("pass_at_1", "pass_at_10")]
    return scored.select("task_id", "opts", "n", "c", *rounded)


@query(
    "mean_pass_at_k",
    f"""with {COUNTS}, scored as (select opts, {_pass(1)} as p1, {_pass(10)} as p10 from counts)
    select l.opts, round(coalesce(avg(p1), 0), 6) as pass_at_1, round(coalesce(avg(p10), 0), 6) as pass_at_10
    from {LEVELS.replace("levels(", "l(")} left join scored s on s.opts = l.opts group by l.opts""",
)
def mean_pass_at_k(spark, sf_dir):
    means = scoring.mean_pass_at_k(bind(spark, sf_dir, VERDICTS))
    return means.select("opts", F.round("pass_at_1", 6).alias("pass_at_1"), F.round("pass_at_10", 6).alias("pass_at_10"))


LAST_VERDICT = f"""
v as ({VERDICTS}),
last_verdict as (
  select * from (select *, row_number() over (partition by task_id, opts order by sample desc) as rn from v) where rn = 1)
"""


@query(
    "rates_over_fixed_quarter",
    f"""with {LAST_VERDICT}, tasks as (select distinct task_id, opts from v),
    quarter as (select floor(count(*) / 4) as q from tasks)
    select l.opts, round(coalesce(sum(flag_compile), 0) / max(q), 6) as compile_rate,
           round(coalesce(sum(flag_run), 0) / max(q), 6) as run_rate
    from {LEVELS.replace("levels(", "l(")} left join last_verdict d on d.opts = l.opts, quarter group by l.opts""",
)
def rates_over_fixed_quarter(spark, sf_dir):
    verdicts = bind(spark, sf_dir, VERDICTS).select("task_id", "opts", "sample", "flag_compile", "flag_run")
    last = last_write(verdicts, ["task_id", "opts"], ["sample"])
    rates = scoring.fixed_denominator_rates(last, last.select("task_id", "opts"))
    return rates.select("opts", *[F.round(c, 6).alias(c) for c in ("compile_rate", "run_rate")])


@query(
    "rates_over_evaluated",
    f"""with v as ({VERDICTS})
    select opts, count(*) as evaluated, cast(sum(flag_compile) as bigint) as compile_success,
           round(avg(flag_compile), 6) as compile_rate,
           cast(sum(flag_run) as bigint) as run_success, round(avg(flag_run), 6) as run_rate
    from v group by opts""",
)
def rates_over_evaluated(spark, sf_dir):
    rates = scoring.evaluated_rates(bind(spark, sf_dir, VERDICTS))
    return rates.withColumns({c: F.round(c, 6) for c in ("compile_rate", "run_rate")})


@query(
    "stage_funnel",
    f"""with v as ({VERDICTS}), staged as (
      select opts, bare_compile = 1 as bare, has_target = 1 and deps_compile = 1 as deps,
             has_target = 1 and deps_compile = 1 and linked = 1 as links,
             has_target = 1 and deps_compile = 1 and linked = 1 and ran = 1 as runs,
             has_target = 1 and deps_compile = 1 and linked = 1 and ran = 1 and equal = 1 as good from v)
    select opts, count(*) as evaluated, count(*) filter (bare or deps) as compiled, count(*) filter (links) as linked,
           count(*) filter (runs) as ran, count(*) filter (good) as correct
    from staged group by opts""",
)
def stage_funnel(spark, sf_dir):
    return scoring.stage_funnel(bind(spark, sf_dir, VERDICTS))


@query(
    "success_ids_by_level",
    f"""with v as ({VERDICTS}), passed as (
      select opts, concat_ws('_', task_id, sample, opts) as item,
             row_number() over (partition by opts order by event_id) - 1 as pos from v where flag_run = 1)
    select opts, pos // 1000 as chunk, count(*) as ids, string_agg(item, ',' order by pos) as items
    from passed group by opts, pos // 1000""",
)
def success_ids_by_level(spark, sf_dir):
    verdicts = bind(spark, sf_dir, VERDICTS).withColumn("item", composite_id("task_id", "sample", "opts"))
    chunks = scoring.success_list(verdicts, "flag_run", "event_id", "item")
    return chunks.select("opts", "chunk", F.size("items").cast("bigint").alias("ids"), F.array_join("items", ",").alias("items"))


@query(
    "success_ids_flat",
    f"""with v as ({VERDICTS}), passed as (
      select concat_ws('_', task_id, sample, opts) as item, row_number() over (order by event_id) - 1 as pos
      from v where flag_compile = 1)
    select pos // 1000 as chunk, count(*) as ids, string_agg(item, ',' order by pos) as items
    from passed group by pos // 1000""",
)
def success_ids_flat(spark, sf_dir):
    verdicts = bind(spark, sf_dir, VERDICTS).withColumn("item", composite_id("task_id", "sample", "opts"))
    chunks = scoring.success_list(verdicts, "flag_compile", "event_id", "item", per_level=False)
    return chunks.select("chunk", F.size("items").cast("bigint").alias("ids"), F.array_join("items", ",").alias("items"))


LAST_RESULT = f"""
r as ({RESULTS}),
last_result as (select * from (select *, row_number() over (
   partition by task_id, opts order by file_name desc, line_no desc) as rn from r) where rn = 1)
"""


def _last_results(spark, sf_dir, keys):
    return last_write(bind(spark, sf_dir, RESULTS), keys, ["file_name", "line_no"])


@query(
    "last_result_per_key",
    f"with {LAST_RESULT} select task_id, opts, sample, file_name, line_no, gen from last_result",
)
def last_result_per_key(spark, sf_dir):
    return _last_results(spark, sf_dir, ["task_id", "opts"])


@query(
    "tasks_with_results",
    f"""with {LAST_RESULT}, t as ({TASKS})
    select t.task_id, t.opts, t.c_func, l.gen, l.gen is null as missing
    from t left join last_result l on l.task_id = t.task_id and l.opts = t.opts""",
)
def tasks_with_results(spark, sf_dir):
    results = _last_results(spark, sf_dir, ["task_id", "opts"])
    return matching.join_results(bind(spark, sf_dir, TASKS), results, on_missing="flag")


@query(
    "tasks_by_sample",
    f"""with r as ({RESULTS}), t as ({TASKS}), s as (select unnest(range(20)) as sample),
    last_result as (select * from (select *, row_number() over (
      partition by task_id, sample, opts order by file_name desc, line_no desc) as rn from r) where rn = 1)
    select t.task_id, cast(s.sample as int) as sample, t.opts, concat_ws('_', t.task_id, s.sample, t.opts) as result_id, l.gen,
           l.gen is null as missing
    from t cross join s left join last_result l
      on l.task_id = t.task_id and l.opts = t.opts and l.sample = s.sample""",
)
def tasks_by_sample(spark, sf_dir):
    keys = ["task_id", "sample", "opts"]
    tasks = matching.with_samples(bind(spark, sf_dir, TASKS))
    joined = matching.join_results(tasks, _last_results(spark, sf_dir, keys), keys, on_missing="flag")
    return joined.select("task_id", "sample", "opts", composite_id(*keys).alias("result_id"), "gen", "missing")


@query(
    "entity_texts_attached",
    f"""with s as ({SAMPLES})
    select s.func, 'int ' || l.quality as deps, b.text as wrapper, p.url as expected,
           concat_ws(',', case when l.doc_id is null then 'deps' end, case when b.item_id is null then 'wrapper' end,
                     case when p.page_id is null then 'expected' end) as missing
    from s left join labels l on l.doc_id = s.doc_id left join benchmark b on b.item_id = s.doc_id
      left join pages p on p.page_id = s.doc_id""",
)
def entity_texts_attached(spark, sf_dir):
    def named(table, key, value, column):
        func = F.concat(F.lit("func"), F.col(key).cast("string"))
        return load(spark, sf_dir, table).select(func.alias("func"), value.alias(column))

    deps = F.concat(F.lit("int "), F.col("quality").cast("string"))
    parts = {
        "deps": named("labels", "doc_id", deps, "deps"),
        "wrapper": named("benchmark", "item_id", F.col("text"), "wrapper"),
        "expected": named("pages", "page_id", F.col("url"), "expected"),
    }
    return matching.attach(bind(spark, sf_dir, SAMPLES).select("func"), parts, on_missing="flag")


@query(
    "entities_with_generated",
    f"""with s as ({SAMPLES}) select s.func, s.opts, l.quality, l.toxic from s join labels l on l.doc_id = s.doc_id""",
)
def entities_with_generated(spark, sf_dir):
    generated = load(spark, sf_dir, "labels").select(
        F.concat(F.lit("func"), F.col("doc_id").cast("string")).alias("func"), "quality", "toxic"
    )
    return matching.with_generated(bind(spark, sf_dir, SAMPLES).select("func", "opts"), generated)


@query(
    "members_of_test_list",
    f"""with s as ({SAMPLES}) select func, mode, opts from s
    where doc_id in (select doc_id from labels where quality = 1)""",
)
def members_of_test_list(spark, sf_dir):
    samples = bind(spark, sf_dir, SAMPLES).select("doc_id", "func", "mode", "opts")
    listed = load(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    members = samples.join(listed, "doc_id")
    return matching.members_only(samples.drop("doc_id"), members)


@query(
    "rows_not_done",
    f"""with s as ({SAMPLES}) select func, opts from s where doc_id not in (select doc_id from labels)""",
)
def rows_not_done(spark, sf_dir):
    samples = bind(spark, sf_dir, SAMPLES).select("func", "opts")
    done = load(spark, sf_dir, "labels").select(F.concat(F.lit("func"), F.col("doc_id").cast("string")).alias("func"))
    return matching.not_done(samples, done, ["func"])


CLEANED = f"""
a as ({answers("duckdb")}),
cleaned as (select *, replace(replace(replace(trim(regexp_extract(gen, '```[^\\n]*\\n([\\s\\S]*?)```', 1), chr(10) || ' '),
   '__fastcall', ''), '__cdecl', ''), '__usercall', '') as decom from a),
scored as (select *, levenshtein(sourcecode, decom) as distance,
   case when length(decom) = 0 then 0.0
        else greatest(0.0, 1.0 - levenshtein(sourcecode, decom)::double / length(decom)) end as similarity,
   case when length(sourcecode) = 0 then 0.0
        else greatest(0.0, 1.0 - levenshtein(sourcecode, decom)::double / length(sourcecode)) end as by_source
   from cleaned)
"""


def _cleaned(spark, sf_dir):
    rows = spread(bind(spark, sf_dir, answers("spark")), "conv_id", "turn")
    return rows.withColumn("decom", without_conventions(fenced_code("gen")))


@query(
    "edit_similarity_by_turn",
    f"""with {CLEANED} select conv_id, turn, distance, round(similarity, 6) as similarity,
    round(by_source, 6) as by_source from scored""",
)
def edit_similarity_by_turn(spark, sf_dir):
    rows = _cleaned(spark, sf_dir).withColumn("distance", edit_distance("sourcecode", "decom").cast("bigint"))
    by_generated = edit_similarity("sourcecode", "decom", distance="distance")
    by_source = edit_similarity("sourcecode", "decom", "left", distance="distance")
    return rows.select(
        "conv_id",
        "turn",
        "distance",
        F.round(by_generated, 6).alias("similarity"),
        F.round(by_source, 6).alias("by_source"),
    )


def _mean_oracle(zero: str) -> str:
    return f"""with {CLEANED} select l.opts, round(coalesce(avg({zero}), 0), 6) as mean_similarity
    from {LEVELS.replace("levels(", "l(")} left join (select * from scored where mode = '64') s on s.opts = l.opts
    group by l.opts"""


def _means(spark, sf_dir, drop_zero):
    rows = filters.by_bit_width(_cleaned(spark, sf_dir), "64")
    scored = rows.withColumn("similarity", edit_similarity("sourcecode", "decom"))
    means = scoring.mean_similarity(scored, drop_zero=drop_zero)
    return means.select("opts", F.round("mean_similarity", 6).alias("mean_similarity"))


@query("mean_similarity_with_zeros", _mean_oracle("similarity"))
def mean_similarity_with_zeros(spark, sf_dir):
    return _means(spark, sf_dir, False)


@query("mean_similarity_without_zeros", _mean_oracle("case when similarity <> 0 then similarity end"))
def mean_similarity_without_zeros(spark, sf_dir):
    return _means(spark, sf_dir, True)


@query(
    "metric_report",
    f"""with v as ({VERDICTS}) select opts, concat('64 opt:', opts, ' compile_rate:', printf('%.4f', avg(flag_compile)),
    ' run_rate:', printf('%.4f', avg(flag_run))) as line from v group by opts""",
)
def metric_report(spark, sf_dir):
    rates = scoring.evaluated_rates(bind(spark, sf_dir, VERDICTS))
    columns = [("compile_rate", "compile_rate"), ("run_rate", "run_rate")]
    return rates.select("opts", report_lines(rates, "64", columns).alias("line"))


@query(
    "model_leaderboard",
    f"""with v as ({VERDICTS}), long as (
      select 'flag_compile' as metric, mode, model, opts, avg(flag_compile) * 100 as pct from v group by mode, model, opts
      union all
      select 'flag_run', mode, model, opts, avg(flag_run) * 100 from v group by mode, model, opts),
    scored as (select metric, mode, model,
        round(max(case when opts = 'O0' then pct end), 4) as O0, round(max(case when opts = 'O1' then pct end), 4) as O1,
        round(max(case when opts = 'O2' then pct end), 4) as O2, round(max(case when opts = 'O3' then pct end), 4) as O3,
        round(avg(pct), 4) as "AVG"
      from long group by metric, mode, model)
    select mode, model, metric, O0, O1, O2, O3, "AVG",
      coalesce(O0 = max(O0) over w, false) as best_O0, coalesce(O1 = max(O1) over w, false) as best_O1,
      coalesce(O2 = max(O2) over w, false) as best_O2, coalesce(O3 = max(O3) over w, false) as best_O3,
      coalesce("AVG" = max("AVG") over w, false) as "best_AVG"
    from scored window w as (partition by metric, mode)""",
)
def model_leaderboard(spark, sf_dir):
    return leaderboard(bind(spark, sf_dir, VERDICTS), ["flag_compile", "flag_run"])
