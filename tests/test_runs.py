import pytest

from millrace.sinks import runs

SCHEMA = "id long, text string"


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)


def stored(spark, table):
    return sorted(r["id"] for r in runs.read_runs(spark, table, SCHEMA).collect())


def test_a_repeated_run_counts_once(spark, tmp_path):
    table = str(tmp_path / "t")
    assert stored(spark, table) == []
    runs.write_run(rows(spark, 1, 2), table, "a")
    runs.write_run(rows(spark, 3), table, "b")
    runs.write_run(rows(spark, 1, 2), table, "a")
    assert stored(spark, table) == [1, 2, 3]
    runs.write_run(rows(spark, 7), table, "a")
    assert stored(spark, table) == [3, 7]


def test_a_run_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    runs.write_run(rows(spark, 1), table, "a")
    keep = runs._folder
    monkeypatch.setattr(runs, "_folder", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        runs.write_run(rows(spark, 2), table, "b")
    monkeypatch.setattr(runs, "_folder", keep)
    assert stored(spark, table) == [1]
    runs.write_run(rows(spark, 2), table, "b")
    assert stored(spark, table) == [1, 2]


def test_inputs_without_text_are_reported(spark, tmp_path):
    table = str(tmp_path / "t")
    inputs = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    left = runs.append_generated_run(inputs, rows(spark, 1, 3), ["id"], table, "a")
    assert [r["id"] for r in left.collect()] == [2] and stored(spark, table) == [1, 3]
    with pytest.raises(ValueError):
        runs.write_run(inputs, table, "../b")
