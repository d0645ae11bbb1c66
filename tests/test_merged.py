"""Result files of many tasks, merged into few files or one file each."""

import os

from pyspark.sql import functions as F

from millrace.catalog import QUERIES, flows
from millrace.plans import evaluation
from millrace.sinks.tables import write_merged
from millrace.sources.jsonl import read_lines

SMALL = "/root/testdata/sf0.001"


def lines_of(spark):
    """Three lines for each of 200 tasks, one in 17 cut off, one with a tab between its tokens."""
    line = F.format_string('{"opts":\t"O%d","mode":"64","c_func_decompile":"n%d"}', F.col("id") % 2, F.col("id"))
    value = F.when(F.col("id") % 17 == 0, F.lit('{"opts":')).otherwise(line)
    return spark.range(600).select("id", F.format_string("func%d.jsonl", F.col("id") % 200).alias("name"), value.alias("value"))


def test_merged_files_hold_the_lines_of_single_files(spark, tmp_path):
    lines, single, merged = lines_of(spark), tmp_path / "single", tmp_path / "merged"
    single.mkdir()
    for row in lines.orderBy("id").collect():
        with open(single / row.name, "a") as out:
            out.write(row.value + "\n")
    write_merged(lines, str(merged), "name", ["id"])
    results = {}
    for folder, glob, whole in ((single, "*.jsonl", False), (merged, "*.txt", True)):
        good, bad = evaluation.results_from_files(spark, str(folder), glob, merged=whole)
        rows = [tuple(r) for r in good.orderBy("task_id", "file_name", "line_no").select("task_id", "opts", "mode", "gen").collect()]
        results[whole] = rows, sorted((r.file_name, r.rejected) for r in bad.collect())
    assert results[True] == results[False]
    assert len(results[True][0]) == 564 and len(results[True][1]) == 36


def test_line_without_a_name_is_the_merged_files_own(spark, tmp_path):
    (tmp_path / "part.txt").write_text('func3.jsonl\t {"a":1} \n{"a":2}\nfunc4.jsonl\t\n')
    rows = read_lines(spark, str(tmp_path), "*.txt", merged=True).orderBy("line_no").collect()
    assert [(r.file_name, r.value) for r in rows] == [("func3.jsonl", '{"a":1}'), ("part.txt", '{"a":2}')]


def test_files_do_not_grow_with_the_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(flows, "scratch_path", lambda session, name: str(tmp_path / name))
    assert QUERIES["rates_from_result_files"](spark, SMALL).count() == 4
    written = [name for _, _, names in os.walk(tmp_path / "results") for name in names if name.endswith(".txt")]
    users = spark.read.parquet(f"{SMALL}/events.parquet").select("user_id").distinct().count()
    assert 0 < len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < users
