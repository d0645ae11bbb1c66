import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.functions.similarity import edit_similarity
from millrace.functions.passk import pass_at_k


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("out")).first().out


FENCED = [
    "```c\nint a;\n```", "x ```\n a \n``` y ```c\nb\n``` z", "no fence  \n", "```c int a;```", "```c\nopen only",
    "````\nfour\n````", "```\n```", "  trimmed 　", "a\n```cpp\r\nint b;\r\n```\n```", "```c\n\n\n``` `` ```",
]


@pytest.mark.parametrize("content", FENCED)
def test_fences_match_the_pattern(spark, content):
    for greedy, pattern in ((False, r"```.*?\n((?:.|\n)*?)```"), (True, r"```.*?\n((?:.|\n)*)```")):
        found = re.findall(pattern, content)
        expected = (found[0] if found else content).strip()
        assert one(spark, text.fenced_code("t", greedy), t=content) == expected


# Worked out by hand: generated text, source, and the text with the first call-like names renamed.
RENAMED = [
    ("int add (int x)", "", "int  func0(int x)"),
    ("#include <a.h>\nint add(int x)\nfoo(1)", "#include <a.h>\nint z;", "\nint  func0(int x)\nfoo(1)"),
    ("#include <b.h>\nint f(int x)\n  foo(bar(1))", "#include <a.h>", "#include <b.h>\nint f(int x)\n   func0( func0(1))"),
    ("x = 1;\n#include <a.h>", "#include <a.h>", "x = 1;\n"),
    ("#include XY(1)", "", "#include  func0(1)"),
    ("foo(1)\n#include <a.h>", "#include <a.h>", " func0(1)\n#include <a.h>"),
    ("", "", ""),
]


@pytest.mark.parametrize(("content", "source", "expected"), RENAMED)
def test_first_function_renamed(spark, content, source, expected):
    assert one(spark, text.rename_first_function("t", "s"), t=content, s=source) == expected


def test_all_calls_of_the_line_or_the_first_few_are_renamed(spark):
    line = "aa(bb(cc(dd(ee(ff(gg(hh(ii(jj(1"
    assert one(spark, text.rename_first_function("t", "s"), t=line, s="") == " func0(" * 10 + "1"
    assert one(spark, text.rename_first_function("t", "s", calls=8), t=line, s="") == " func0(" * 8 + "ii(jj(1"


def test_conflicts(spark):
    deps = "a__bench(int) {\nint bc__bench (x, y)  {\nd__bench();"
    body = "a(1) bc (2) xa(3) a_(4) bc.a(5) d(6)"
    expected = "a__bench(1) bc__bench(2) xa(3) a_(4) bc.a__bench(5) d(6)"
    assert one(spark, text.rename_conflicts("d", "t"), d=deps, t=body) == expected
    assert one(spark, text.rename_conflicts("d", "t"), d="", t=body) == body


def test_includes_hoisted(spark):
    program, bare = text.combined_program("f", "t", "g")
    values = {"f": "#include <a.h>\nint f();\n#include <b.h>", "t": "#include <a.h>\nint main(){}\n#include <a.h> x", "g": "G"}
    header = "#include <a.h>\n#include <b.h>\n#include <a.h>\n#include <a.h> x\n"
    assert one(spark, bare, **values) == header + "\nG"
    # Removing the shorter include line also cuts it out of the longer one.
    assert one(spark, program, **values) == header + "\nG\n\nint main(){}\n x"


def test_repoint_include(spark):
    wrapper = 'x\nextern "C" \n{\n#include "old/path.c"\n}\ny "\n}'
    assert one(spark, text.repoint_include("w", "new$1\\2.c"), w=wrapper) == wrapper.replace("old/path.c", "new$1\\2.c")
    assert one(spark, text.repoint_include("w", "n.c"), w="\n".join([wrapper] * 10)).count('"n.c"') == 10


def test_optimized_code(spark):
    answer = "# Optimized Code \n```c\nint x;\n```\n# End"
    assert one(spark, text.optimized_code("a"), a=answer) == "int x;\n"
    assert one(spark, text.apply_optimized("a", "t"), a=answer.replace("int x;", "none"), t="old") == "old"
    assert one(spark, text.apply_optimized("a", "t"), a="# optimized code\nno fence #", t="old") == "old"


def test_lines_mentioning(spark):
    assert one(spark, text.lines_mentioning("t", "n"), t="f1\nx\nf1 y", n="f1") == "f1\nf1 y"
    assert one(spark, text.lines_mentioning("t", "n"), t="f1\nx\n", n="f1") == "f1\n"


def test_long_text_without_recursion(spark):
    body = "int a;\n" * 60000
    assert one(spark, text.fenced_code("t"), t=f"```c\n{body}```") == body.strip()


@pytest.mark.parametrize("left, right, expected", [("abcd", "abxd", 0.75), ("abc", "", 0.0), ("abcdefgh", "x", 0.0),
                                                   ("same", "same", 1.0), ("größe", "grosse", 0.5), ("", "abc", 0.0)])
def test_similarity(spark, left, right, expected):
    assert one(spark, edit_similarity("a", "b"), a=left, b=right) == pytest.approx(expected)


@pytest.mark.parametrize("n, c, k, expected", [(20, 0, 1, 0.0), (20, 5, 1, 0.25), (20, 5, 10, 0.98374613), (20, 11, 10, 1.0)])
def test_pass_at_k(spark, n, c, k, expected):
    frame = spark.createDataFrame([(n, c)], "n int, c int")
    assert frame.select(pass_at_k("n", "c", k)).first()[0] == pytest.approx(expected)


def test_pass_at_k_rises(spark):
    frame = spark.range(1, 13).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id"))).alias("c"))
    rows = frame.select("n", "c", *[pass_at_k("n", "c", k).alias(f"p{k}") for k in (1, 2, 3)]).collect()
    by = {(r.n, r.c): r for r in rows}
    for (n, c), r in by.items():
        assert r.p1 <= r.p2 + 1e-12 <= r.p3 + 2e-12 <= 1 + 3e-12
        assert c == 0 or r.p2 >= by[n, c - 1].p2 - 1e-12
