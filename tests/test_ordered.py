import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators.latest import last_write
from millrace.operators.ordered import digest_bucket, id_bucket, sketch_bucket, with_positions


def test_positions_equal_windows_on_a_hot_key(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"),
        ((F.col("id") * 7919) % 3001).alias("n"),
        (F.col("id") % 11).alias("v"),
    )
    window = Window.partitionBy("k").orderBy("n")
    expected = frame.select("k", "n", (F.row_number().over(window) - 1).alias("pos"), F.sum("v").over(window).alias("total"),
                            F.count(F.lit(1)).over(Window.partitionBy("k")).alias("rows"))
    seen = with_positions(frame, ["k"], ["n"], id_bucket("n", 64), running={"total": "v"}, count="rows")
    columns = ["k", "n", "pos", "total", "rows"]
    assert sorted(map(repr, seen.select(columns).collect())) == sorted(map(repr, expected.select(columns).collect()))


def test_digest_order_without_keys(spark):
    frame = spark.range(500).select("id", F.md5(F.col("id").cast("string")).alias("d"))
    seen = with_positions(frame, [], ["d"], digest_bucket("d", 2)).orderBy("pos").collect()
    assert [r.pos for r in seen] == list(range(500))
    assert [r.d for r in seen] == sorted(r.d for r in seen)


def test_last_write(spark):
    rows = [("a", 1, "f1", 5), ("a", 2, "f2", 1), ("a", 3, "f1", 9), ("b", 4, "f0", 0)]
    frame = spark.createDataFrame(rows, "k string, v int, f string, line int")
    assert {r.k: r.v for r in last_write(frame, ["k"], ["f", "line"]).collect()} == {"a": 2, "b": 4}


def test_null_key_is_an_error(spark):
    frame = spark.createDataFrame([("a", 1), (None, 2)], "k string, n int")
    with pytest.raises(Exception, match="null key or bucket"):
        with_positions(frame, ["k"], ["n"], id_bucket("n")).collect()


def test_sketched_buckets_are_even_however_ids_lie(spark):
    hashed, dense, strided = F.xxhash64("id"), F.col("id"), F.col("id") * 1_000_000_007
    ids = F.when(F.col("id") % 3 == 0, dense).when(F.col("id") % 3 == 1, hashed).otherwise(strided)
    for column in (hashed, dense, strided, ids):
        frame = spark.range(50_000).select(column.alias("n"))
        sizes = frame.groupBy(sketch_bucket(frame, "n", 1000).alias("b")).agg(F.count("n").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))
        sizes = sizes.orderBy("b").collect()
        assert 40 <= len(sizes) <= 50 and max(r["rows"] for r in sizes) <= 2000
        assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]))


def test_positions_over_sketched_buckets(spark):
    frame = spark.range(2000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("n"))
    seen = with_positions(frame, ["k"], ["n"], sketch_bucket(frame, "n", 50))
    wanted = frame.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("n")) - 1)
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, wanted.collect()))
    assert frame.limit(0).select(sketch_bucket(frame.limit(0), "n")).count() == 0
    with pytest.raises(Exception, match="null key or bucket"):
        holed = spark.createDataFrame([(1, None), (1, 5)], "k int, n long")
        with_positions(holed, ["k"], ["n"], sketch_bucket(holed, "n")).collect()
