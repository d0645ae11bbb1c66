import json
import random
import time

from millrace.functions import jsontext
from millrace.functions.codescan import select_function, target_function
from millrace.operators import filters


def test_same_output(spark):
    pairs = [("{}", '{"a":1}', True), ("1", "1.0", False), ("1.0", "1.0000000000001", True), ("1.0", "1.001", False),
             ("[1,[2]]", "[1,[2]]", True), ("[1]", "[1,2]", False), ('{"a":1,"b":2}', '{"a":1}', False), ("true", "1", False),
             ('{"a":{"x":[]}}', '{"a":{"x":[],"y":0}}', True), ("null", "null", True), ("", '{"a":1}', False), ('"x"', '"x"', True)]
    frame = spark.createDataFrame(pairs, "o string, e string, want boolean")
    for row in frame.select("*", jsontext.same_output("o", "e").alias("got")).collect():
        assert row.got == row.want, row


def test_python_json_bytes(spark):
    random.seed(2)
    texts = ['{"b":1.50,"a":[1e5,2E-7,"é\\u00e9\\n"],"":{}}', "[ ]", "null", "-0", "1e400", '{"a":1,"a":2}', '"\\ud83d\\ude00"']
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", jsontext.python_json("t").alias("a"), jsontext.python_json("t", False).alias("r")).collect()
    for row in rows:
        assert row.a == json.dumps(json.loads(row.t)) and row.r == json.dumps(json.loads(row.t), ensure_ascii=False)
    bad = spark.createDataFrame([("{",), (None,)], "t string").select(jsontext.python_json("t").alias("a")).collect()
    assert [r.a for r in bad] == [None, None]


def test_falsy(spark):
    values = ["null", "{}", "[]", '""', "0", "0.0", "-0.0", "0e0", "false", "true", "1", '"0"', '"[]"', "[0]", '{"a":0}', "0.5", '"null"']
    frame = spark.createDataFrame([(v, json.dumps({".rodata": json.loads(v)})) for v in values], "v string, d string")
    for row in frame.select("v", jsontext.is_falsy("d", "$['.rodata']").alias("f")).collect():
        assert row.f == (not json.loads(row.v)), row


def test_data_filter_needs_both_empty(spark):
    rows = [(1, '{".rodata":{},".data":[]}'), (2, '{".rodata":{"a":1},".data":[]}'), (3, '{".rodata":"",".data":[0]}')]
    frame = spark.createDataFrame(rows, "id int, data string")
    assert sorted(r.id for r in filters.with_real_data(frame).collect()) == [2, 3]


def test_mappings(spark):
    rows = [('{"param":1,".rodata":2,".data":3,".bss":4,"x":5}',), ('{"param":1}',), ("{",)]
    frame = spark.createDataFrame(rows, "d string")
    got = [r[0] for r in frame.select(jsontext.data_mapping("d")).collect()]
    assert json.loads(got[0]) == dict(zip(jsontext.DATA_KEYS, (1, 2, 3, 4))) and got[1:] == [None, None]
    graph = spark.createDataFrame([('{"nodes":[],"nodenum":1}',)], "g string")
    assert graph.select(jsontext.graph_mapping("g")).first()[0] is None
    assert json.loads(graph.select(jsontext.graph_mapping("g", default_edges=True)).first()[0])["edges between two connected cfg_blocks"] == []


def test_wrap_strings(spark):
    frame = spark.createDataFrame([('{"a":"x","b":[1]}',), ("{}",), ('{"a":1}',), ('["a"]',)], "d string")
    assert [r[0] for r in frame.select(jsontext.wrap_strings("d")).collect()] == ['{"a": ["x"], "b": [1]}', "{}", None, None]


HELPER = "static int helper(int a) { return a; }\n"


def test_select_only_definition():
    out = select_function("// int no(int)\nint old(int a) {\n  int b = 5;\n  char *s = \"f(\";\n  return a;\n}\n", "new", "last")
    assert out == {"text": "int b = 5;\nint new(int a) {\n  int b = 5;\n  char *s = \"f(\";\n  return a;\n}", "renamed": True, "candidates": 1}


def test_select_uncalled_definition():
    out = select_function(HELPER + "int *top(int a)\n{ if (a) { return helper(a); } return 0; }", "f", "last")
    assert out["text"] == "int *f(int a)\n{ if (a) { return helper(a); } return 0; }" and out["candidates"] == 1


def test_select_among_rivals():
    code = "int one(int a) { return a + a + a + a; }\nint two(void) { return 2; }"
    assert select_function(code, "f", "last")["text"] == "int f(void) { return 2; }"
    assert select_function(code, "f", "longest")["text"] == "int f(int a) { return a + a + a + a; }"


def test_select_all_called():
    out = select_function("int a1(int x) { return b1(x); }\nint b1(int x) { return a1(x); }", "f", "last")
    assert out["text"] == "int f(int x) { return a1(x); }" and out["candidates"] == 2


def test_select_without_definition_or_type():
    assert select_function("int x = 0x10;\nint y = g(2);\n", "f", "last") == {"text": "int x = 0x10;", "renamed": False, "candidates": 0}
    out = select_function("main(void) { return 0; }", "f", "last")
    assert out["text"] == "main(void) { return 0; }" and not out["renamed"]


def test_target_function_column(spark):
    frame = spark.createDataFrame([(HELPER, "f"), (None, "g")], "t string, n string")
    rows = frame.select(target_function("t", "n").alias("o")).collect()
    assert rows[0].o.text == "static int f(int a) { return a; }" and rows[1].o is None


DEEP = "[" * 100_000


def test_values_that_cannot_be_converted_give_null(spark):
    rows = [('{"a": "\\ud800"}',), (DEEP,), ("{",), (None,), ('{"a": 1}',)]
    frame = spark.createDataFrame(rows, "t string")
    raw = [row[0] for row in frame.select(jsontext.python_json("t", ascii_only=False)).collect()]
    assert raw == [None, None, None, None, '{"a": 1}']
    assert frame.select(jsontext.wrap_strings("t")).collect()[1][0] is None
    assert frame.select(jsontext.same_output("t", "t")).collect()[1][0] is None


def test_declarations_with_several_names():
    out = select_function("int a = 1, b = 2;\nint c, *d = 0x1F;\nint e = f(1);\nint g, h;\nint i(int j) { return j; }", "k", "last")
    assert out["text"] == "int a = 1, b = 2;\nint c, *d = 0x1F;\nint k(int j) { return j; }"


def test_broken_code_is_read_once():
    start = time.perf_counter()
    out = select_function("int f(int a { ((( x\n" * 20_000 + "word " * 50_000 + "\nint g(void) { return 1; }", "h", "last")
    assert out["text"].endswith("{ return 1; }") and time.perf_counter() - start < 5
