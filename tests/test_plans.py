"""Physical plans: what is pushed down, shuffled, and run once."""

import re

from pyspark.sql import functions as F

from millrace.functions.jsontext import data_mapping
from millrace.operators import filters, packing, scoring
from millrace.operators.latest import last_write
from millrace.operators.ordered import id_bucket, with_positions


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, frame):
    path = str(tmp_path / "table")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def test_width_filter_reaches_the_scan(spark, tmp_path):
    table = stored(spark, tmp_path, spark.createDataFrame([("64", "a", "b")], "mode string, gen string, other string"))
    plan = plan_of(filters.by_bit_width(table, "64").select("gen"))
    assert "EqualTo(mode,64)" in plan and "ReadSchema: struct<mode:string,gen:string>" in plan


def test_packing_plan_reads_no_tokens(spark, tmp_path):
    rows = [(1, 0, 0, 3, [1, 2, 3], [1, 2, 3])]
    schema = "row_id bigint, part int, split int, seq_length int, input_ids array<int>, labels array<int>"
    table = stored(spark, tmp_path, spark.createDataFrame(rows, schema))
    plan = plan_of(packing.plan_packing(table.select("row_id", "part", "split", "seq_length"), 16))
    assert "input_ids" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_positions_shuffle_rows_once(spark, tmp_path):
    table = stored(spark, tmp_path, spark.range(1000).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("text")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(with_positions(table, ["k"], ["id"], id_bucket("id", 64)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # One exchange for the rows and one for the bucket sizes; the join adds none
    # on the rows' side, where the window already partitioned and sorted them.
    assert len(re.findall(r"Exchange hashpartitioning\(k#\d+L, _bucket#\d+L, ", plan)) == 2
    assert plan.count("Exchange hashpartitioning") == 4 and "SortMergeJoin" in plan


def test_filters_do_not_repeat_python(spark, tmp_path):
    table = stored(spark, tmp_path, spark.createDataFrame([('{"param":1}',)], "data string"))
    mapped = table.withColumn("mapping", data_mapping("data")).filter(F.col("mapping").isNotNull())
    assert plan_of(mapped).count("ArrowEvalPython") == 1


def test_aggregates_combine_before_the_shuffle(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).alias("task_id"), F.lit("O0").alias("opts"), F.lit(1).alias("flag_run"), F.col("id").alias("line"))
    table = stored(spark, tmp_path, rows)
    assert "partial_sum" in plan_of(scoring.mean_pass_at_k(table))
    plan = plan_of(last_write(table, ["task_id", "opts"], ["line"]))
    assert "partial_max_by" in plan and "Window" not in plan
