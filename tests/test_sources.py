import json

import pytest

from millrace.functions.tokenizers import ByteTokenizer
from millrace.operators import matching
from millrace.sinks import tables as sinks
from millrace.sources import jsonl, shards


@pytest.fixture
def folder(tmp_path):
    first = tmp_path / "new_input_3"
    first.mkdir()
    (first / "a.jsonl").write_text('  {"func": "f", "data": {"a": "é"}}\n\n{broken\n[1]\n{"asm_obj": "x", "assemgraph": [1]}\n', encoding="utf-8")
    (first / "b.txt").write_text('{"func": "no"}\n')
    second = tmp_path / "set_b_12"
    second.mkdir()
    (second / "c.jsonl").write_text("".join(json.dumps({"func": f"g{i}"}) + "\n" for i in range(50)))
    return str(tmp_path)


def test_jsonl_folder(spark, folder):
    good, bad = jsonl.read_samples(spark, folder)
    rows = {r.canonical: r for r in good.collect()}
    assert '{"func": "f", "data": "{\\"a\\": \\"é\\"}", "asm_obj": ""}' in rows
    assert '{"asm_obj": "x", "assemgraph": "[1]"}' in rows and len(rows) == 52
    assert sorted((r.rejected, r.file_name) for r in bad.collect()) == [("[1]", "a.jsonl"), ("{broken", "a.jsonl")]
    assert {r.part for r in good.select("part").distinct().collect()} == {"3", "12"}


def test_lines_keep_file_order(spark, folder):
    lines = jsonl.read_lines(spark, folder).filter("file_name = 'c.jsonl'").orderBy("line_no").collect()
    assert [json.loads(r.value)["func"] for r in lines] == [f"g{i}" for i in range(50)]


def test_split_files_keep_order(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"n": i}) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = jsonl.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [json.loads(r.value)["n"] for r in lines] == list(range(2000))


def test_typed_read_requires_columns(spark, folder):
    with pytest.raises(Exception, match="missing columns: func"):
        jsonl.read_typed(spark, folder, "func string, asm_obj string", ["func", "asm_obj"]).collect()


def test_json_files(spark, tmp_path):
    (tmp_path / "tasks.json").write_text('[{"task_id": 1, "type": "O0"},\n {"task_id": 2, "type": "O1"}]')
    (tmp_path / "source.json").write_text('{"f": "int f;\\n", "g": "int g;"}')
    (tmp_path / "nodata.json").write_text('{"64": {"O0": ["f", "g"], "O1": []}, "32": {"O3": ["f"]}}')
    (tmp_path / "names.txt").write_text("['f', \"g\", 'it\\'s']")
    read = jsonl.read_json_array(spark, str(tmp_path / "tasks.json"), "task_id int, type string")
    assert [(r.task_id, r.type) for r in read.collect()] == [(1, "O0"), (2, "O1")]
    pairs = jsonl.read_json_object(spark, str(tmp_path), "source.json").collect()
    assert {r.key: r.value for r in pairs} == {"f": "int f;\n", "g": "int g;"}
    members = jsonl.read_membership(spark, str(tmp_path), "nodata.json").collect()
    assert {tuple(r) for r in members} == {("64", "O0", "f"), ("64", "O0", "g"), ("32", "O3", "f")}
    names = jsonl.read_name_list(spark, str(tmp_path), "names.txt").orderBy("pos").collect()
    assert [r.func for r in names] == ["f", "g", "it's"]


def test_entity_files(spark, tmp_path):
    for name, body in {"f_64_deps.c": "int d;\nint e;\n", "g_64_deps.c": "x", "f_O0.c": "gen", "f_O0_only.c": "only", "f.json": "{}"}.items():
        (tmp_path / name).write_text(body)
    deps = jsonl.read_entity_texts(spark, str(tmp_path), "_64_deps.c")
    assert {r.func: r.text for r in deps.collect()} == {"f": "int d;\nint e;\n", "g": "x"}
    generated = jsonl.read_level_texts(spark, str(tmp_path)).collect()
    assert [(r.func, r.opts, r.text) for r in generated] == [("f", "O0", "gen")]
    only = jsonl.read_level_texts(spark, str(tmp_path), "_only.c").collect()
    assert [(r.func, r.text) for r in only] == [("f", "only")]


def test_missing_results_are_errors(spark):
    tasks = spark.createDataFrame([(1, "O0"), (2, "O0")], "task_id int, opts string")
    results = spark.createDataFrame([(1, "O0", "x")], "task_id int, opts string, gen string")
    assert matching.join_results(tasks, results, on_missing="skip").count() == 1
    with pytest.raises(Exception, match="task without gen"):
        matching.join_results(tasks, results).collect()
    with pytest.raises(Exception, match="gen not found"):
        matching.attach(tasks, {"gen": results}, key="task_id").collect()


def test_packed_shards(spark, tmp_path):
    plain, split = str(tmp_path / "plain"), str(tmp_path / "split")
    spark.createDataFrame([([1],)], "input_ids array<int>").write.parquet(plain)
    rows = spark.createDataFrame([([2], "train"), ([3], "validation")], "input_ids array<int>, dataset string")
    rows.write.partitionBy("dataset").parquet(split)
    assert shards.read_packed(spark, [plain, split], "dev").count() == 2
    assert shards.read_packed(spark, split).collect()[0].input_ids == [2]
    assert shards.read_packed(spark, split, "test") is None
    with pytest.raises(ValueError):
        shards.read_packed(spark, plain, "other")


def test_shard_name(spark):
    frame = spark.createDataFrame([("7", 12)], "part string, split int")
    assert frame.select(sinks.shard_name()).first()[0] == "part-7-00012"


def test_byte_tokenizer_handles_slices_and_nulls(spark):
    texts = [None, "", "é", "abc" * 50, None, "z"] * 40
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(3)
    for row in frame.select("t", ByteTokenizer().encode("t").alias("ids")).collect():
        assert row.ids == (None if row.t is None else list(row.t.encode()))


def test_names_are_read_as_they_are_and_paths_tell_files_apart(spark, tmp_path):
    for folder in ("x/my dir_1", "y/my dir_1"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "a+b ü%20.jsonl").write_text('{"func": "f"}\n')
    rows = jsonl.read_lines(spark, str(tmp_path)).collect()
    assert {(row.folder, row.part, row.file_name) for row in rows} == {("my dir_1", "1", "a+b ü%20.jsonl")}
    assert len({row.path for row in rows}) == 2
    texts = jsonl.read_entity_texts(spark, str(tmp_path), " ü%20.jsonl").collect()
    assert {row.func for row in texts} == {"a+b"}


def test_lines_of_samples_are_stripped_once(spark, tmp_path, capsys):
    (tmp_path / "a.jsonl").write_text('\u3000 {"func": "f"}\t\n \u2003 \n{"func"  \n', "utf-8")
    good, bad = jsonl.read_samples(spark, str(tmp_path))
    assert [row.canonical for row in good.collect()] == ['{"func": "f", "asm_obj": ""}']
    assert [row.rejected for row in bad.collect()] == ['{"func"']
    good.explain()
    assert capsys.readouterr().out.count("trim(") == 1
