"""From generated text to programs, verdicts, similarities and reports.

Compiling and running programs happens outside; its verdicts come back as a
table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.codescan import target_function
from millrace.functions.jsontext import same_output
from millrace.functions.similarity import edit_similarity
from millrace.operators import filters, matching, scoring
from millrace.operators.latest import last_write
from millrace.sinks.tables import report_lines
from millrace.sources.jsonl import read_samples


def task_programs(
    tasks: DataFrame,
    results: DataFrame,
    bits: str,
    samples: int | None = None,
    legacy: bool = False,
    on_missing: str = "error",
    renamed_calls: int | None = None,
) -> DataFrame:
    """Programs to compile for each task, or for each task and sample.

    ``tasks`` has ``task_id, opts, c_func, c_test`` and ``results`` the generated
    lines with ``file_name`` and ``line_no``; the last line of a key counts.
    ``legacy`` only deletes fence marks instead of taking the fenced code and
    renaming its function, at all calls on its line or the first ``renamed_calls``.
    """
    keys = ["task_id", "opts"] if samples is None else ["task_id", "sample", "opts"]
    wanted = tasks if samples is None else matching.with_samples(tasks, samples)
    of_width = filters.by_bit_width(results, bits).select(*keys, "file_name", "line_no", "gen")
    joined = matching.join_results(wanted, last_write(of_width, keys, ["file_name", "line_no"]), keys, "gen", on_missing)
    if legacy:
        cleaned = joined.withColumn("decom", text.without_fence_marks("gen"))
    else:
        fenced = joined.withColumn("decom", text.fenced_code("gen"))
        cleaned = fenced.withColumn("decom", text.rename_first_function("decom", "c_func", calls=renamed_calls))
    program, bare = text.combined_program("c_func", "c_test", "decom")
    return cleaned.select(*keys, text.composite_id(*keys).alias("result_id"), bare.alias("bare"), program.alias("program"))


def results_from_files(
    spark: SparkSession,
    folder: str,
    glob: str = "*.jsonl",
    gen: str = "c_func_decompile",
    named_by: str = "file",
    merged: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Generated lines of a result folder as ``task_id, opts, mode, gen`` in file and line order, and the rejected lines.

    The task is the digits of the file's name, or of its folder's; a line without
    a level, a width or an answer stays, with nulls, and is no result of any task.
    Files of many tasks are read with ``merged``; see ``read_lines``.
    """
    good, bad = read_samples(spark, folder, glob, merged)
    name = {"file": "file_name", "folder": "folder"}[named_by]
    fields = [F.get_json_object("canonical", f"$.{key}").alias(key) for key in ("opts", "mode")]
    results = good.select(
        text.digits_of(name).try_cast("bigint").alias("task_id"),
        *fields,
        F.get_json_object("canonical", f"$.{gen}").alias("gen"),
        F.col("path").alias("file_name"),
        "line_no",
    )
    return results, bad


def evaluate_files(
    tasks: DataFrame,
    folder: str,
    judge: Callable[[DataFrame], DataFrame],
    bits: str,
    label: str,
    glob: str = "*.jsonl",
    named_by: str = "file",
    on_missing: str = "error",
    merged: bool = False,
) -> DataFrame:
    """Rates per level, with their report line, from a folder of generated files.

    ``judge`` turns programs (``task_id, opts, program`` and others) into rows with
    ``flag_compile`` and ``flag_run``, from wherever programs are compiled and run.
    """
    results, _ = results_from_files(tasks.sparkSession, folder, glob, named_by=named_by, merged=merged)
    programs = task_programs(tasks, results, bits, on_missing=on_missing)
    rates = scoring.fixed_denominator_rates(judge(programs), tasks)
    columns = [("compile_rate", "compile_rate"), ("run_rate", "run_rate")]
    return rates.withColumn("line", report_lines(rates, label, columns))


def answer_similarity(
    answers: DataFrame,
    bits: str,
    real_graph: bool = False,
    real_data: bool = False,
    pseudo_code: bool = False,
    graph: str = "assemgraph",
) -> DataFrame:
    """Mean similarity of source and answer per level, zeros kept.

    ``answers`` has ``func, opts, mode, sourcecode``, the JSON columns for the
    optional tests, ``gen`` (or ``pscode`` with ``pseudo_code``), ``file_name``
    and ``line_no``; the last line of a function and level counts.
    """
    rows = filters.by_bit_width(answers, bits)
    if real_graph:
        rows = filters.with_real_graph(rows, graph)
    if real_data:
        rows = filters.with_real_data(rows)
    answer = "pscode" if pseudo_code else "gen"
    picked = rows.select("func", "opts", "file_name", "line_no", "sourcecode", F.col(answer).alias("gen"))
    last = last_write(picked, ["func", "opts"], ["file_name", "line_no"])
    decom = text.fenced_code("gen")
    cleaned = last.withColumn("decom", text.without_conventions(decom) if pseudo_code else decom)
    return scoring.mean_similarity(cleaned.withColumn("similarity", edit_similarity("sourcecode", "decom")))


def function_similarity(
    sources: DataFrame,
    programs: DataFrame,
    fallback: DataFrame,
    members: DataFrame | None = None,
) -> DataFrame:
    """Similarity of each function's source and the program lines that mention it.

    ``sources`` has ``func, sourcecode``; ``programs`` and ``fallback`` have
    ``func, opts, text``. A program without such a line is replaced by the
    function's fallback text, and without one the pair is left out.
    ``members`` restricts the ``(func, opts)`` pairs.
    """
    kept = programs if members is None else matching.members_only(programs, members, ["func", "opts"])
    paired = matching.with_generated(sources, kept)
    spare = fallback.select("func", "opts", F.col("text").alias("spare"))
    joined = paired.join(spare, ["func", "opts"], "left")
    chosen = joined.withColumn("decom", text.first_nonempty(text.lines_mentioning("text", "func"), "spare"))
    present = filters.present(chosen, "decom")
    return present.select("func", "opts", edit_similarity("sourcecode", "decom").alias("similarity"))


def function_programs(
    names: DataFrame,
    generated: DataFrame,
    bits: str,
    pseudo_code: bool = False,
    pick: str = "last",
    on_missing: str = "error",
) -> tuple[DataFrame, DataFrame]:
    """Programs of generated functions with their dependencies, and skipped counts.

    ``names`` has ``func, deps``; ``generated`` has ``func, opts, mode, gen``. The
    fenced text goes to the first compile as ``bare``; the selected function,
    renamed and with conflicting calls renamed, follows the dependencies in
    ``program``, which is null where no function was found.
    """
    rows = filters.by_bit_width(generated, bits)
    joined = matching.attach(rows, {"deps": names}, on_missing=on_missing)
    cleaned = text.fenced_code("gen", greedy=True)
    bare = joined.withColumn("bare", text.without_conventions(cleaned, spaced=True) if pseudo_code else cleaned)
    kept, skipped = filters.generated_only(bare, "bare")
    chosen = kept.withColumn("chosen", target_function("bare", "func", pick))
    renamed = F.nullif(text.rename_conflicts("deps", "chosen.text"), F.lit(""))
    programs = chosen.select(
        "func",
        "opts",
        text.composite_id("func", "opts").alias("target"),
        "bare",
        "chosen.renamed",
        text.with_dependencies("deps", renamed).alias("program"),
    )
    return programs, skipped


def output_verdicts(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """Run verdicts from observed outputs: ``flag_run`` where they match the expected.

    ``outputs`` has ``func, opts, observed`` and ``expected`` has ``func, expected``.
    """
    joined = matching.attach(outputs, {"expected": expected})
    equal = F.coalesce(same_output("observed", "expected"), F.lit(False))
    return joined.select("func", "opts", equal.cast("int").alias("flag_run"))
