"""The corpus flow from files to packed rows against a plain Python run."""

import json
import math
import random

import pytest
from test_packing import fold

from millrace.plans import corpus, evaluation
from millrace.sources.shards import read_packed

OPENING = (
    "Please understand the following assembly code and data mapping table (defines the correspondence between data "
    "labels and their actual values), and perform decompilation into corresponding high-level C source code."
)


def prompt_of(sample):
    """The single-block prompt; the samples here have one block."""
    data = sample["data"]
    mapping = json.dumps({
        "stack variables (size and relative offset)": data["param"],
        "read-only constants (size and value)": data[".rodata"],
        "initialized global/static data (size and initial value)": data[".data"],
        "uninitialized global/static data (size and count)": data[".bss"],
    })
    pad = " " * 8
    return (
        f"{OPENING}\n\n{pad}- The assembly code:\n{pad}```Assembly\n{pad}{sample['asm_ida_com']}\n{pad}```\n\n"
        f"{pad}- The data mapping table:\n{pad}```Json\n{pad}{mapping}\n{pad}```\n\n{pad}The high-level C source code is: "
    )


@pytest.mark.parametrize("keep_residual", [True, False])
def test_corpus(spark, tmp_path, keep_residual):
    random.seed(11)
    source, target, limit, budget, parts, bins = tmp_path / "in", tmp_path / "out", 900, 800, 3, 2
    layout = {"alpha": ["f1.jsonl", "f10.jsonl", "f2.jsonl", "g.jsonl"], "beta": ["a.jsonl"]}
    by_part, rejected, broken = {}, 0, 0
    for folder, files in layout.items():
        (source / folder).mkdir(parents=True)
        for place, name in enumerate(sorted(files)):
            part = place // math.ceil(len(files) / parts)
            rows = []
            for _ in range(random.randint(5, 60)):
                sample = {"arch": "x86", "mode": "64", "opts": "O0", "sourcecode": "x" * random.randint(0, 260) + "é",
                          "asm_ida_com": "nop\n" * random.randint(0, 20),
                          "data": {"param": [1.50], ".rodata": "ü", ".data": [], ".bss": None},
                          "assemgraph_com": {"nodes": [], "edges": [], "nodenum": random.choice([0, 1, 1, 1])}}
                rows.append(sample)
            lines = [json.dumps(r, ensure_ascii=False) for r in rows]
            lines.insert(1, "{oops")
            broken += 1
            (source / folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
            by_part.setdefault(part, []).extend(((folder, name, i), r) for i, r in enumerate(rows))
    expected = []
    for part, rows in by_part.items():
        rows = [r for _, r in sorted(rows, key=lambda item: item[0])]
        bounds = [round(len(rows) * p / 100) for p in (0, 50)] + [len(rows)]
        for split in range(bins):
            tokens = []
            for place in range(bounds[split], bounds[split + 1]):
                sample = rows[place]
                if sample["assemgraph_com"]["nodenum"] != 1:
                    rejected += 1
                    continue
                prompt = list(prompt_of(sample).encode())
                ids = [256, *prompt, *sample["sourcecode"].encode(), 257]
                hidden = len(prompt) + 1
                labels = [-100] * hidden + ids[hidden:]
                ids, labels = ids[:limit], labels[:limit]
                if labels.count(-100) < budget:
                    tokens.append((len(ids), place, ids, labels))
            tokens.sort(key=lambda t: t[:2])
            packed = {}
            for (_, _, ids, labels), (buffer, bin_, _, residual) in zip(tokens, fold([t[0] for t in tokens], limit)):
                if keep_residual or not residual:
                    both = packed.setdefault((part, split, buffer, bin_), ([], []))
                    both[0].extend(ids)
                    both[1].extend(labels)
            expected += [(*key, *value) for key, value in packed.items()]
    stats = corpus.prepare_corpus(spark, str(source), str(target), parts, bins, limit, budget, keep_residual=keep_residual)
    seen = read_packed(spark, str(target / "packed")).collect()
    key = lambda row: row[:4]
    assert sorted(((r.part, r.split, r.buffer, r.bin, r.input_ids, r.labels) for r in seen), key=key) == sorted(expected, key=key)
    total = [r for r in stats.collect() if r.part is None][0]
    assert total.packed_rows == len(expected)
    assert spark.read.json(str(target / "rejected_lines")).count() == broken
    assert spark.read.json(str(target / "rejected_samples")).count() == rejected


def test_function_programs(spark):
    names = spark.createDataFrame([("f", "int g__bench(int x) {}"), ("h", "")], "func string, deps string")
    answer = "```c\nint g(int x) { return 1; }\nint old(int x) { return g(x); }\n```"
    rows = [("f", "O0", "64", answer), ("h", "O0", "64", ""), ("h", "O1", "64", "text only"), ("f", "O1", "32", answer)]
    generated = spark.createDataFrame(rows, "func string, opts string, mode string, gen string")
    programs, skipped = evaluation.function_programs(names, generated, "64")
    out = {r.target: r for r in programs.collect()}
    assert out["f_O0"].program == "int g__bench(int x) {}\nint f(int x) { return g__bench(x); }"
    assert out["h_O1"].program is None and set(out) == {"f_O0", "h_O1"}
    assert {r.opts: r.skipped for r in skipped.collect()} == {"O0": 1, "O1": 0}


def test_legacy_programs(spark):
    tasks = spark.createDataFrame([(1, "O0", "int f;", "#include <t.h>\nmain")], "task_id int, opts string, c_func string, c_test string")
    rows = [(1, "O0", "64", "a", 1, "```cold```"), (1, "O0", "64", "a", 2, "```c\nnew()\n```"), (1, "O0", "32", "a", 3, "no")]
    results = spark.createDataFrame(rows, "task_id int, opts string, mode string, file_name string, line_no int, gen string")
    out = evaluation.task_programs(tasks, results, "64", legacy=True).collect()
    assert [r.program for r in out] == ["#include <t.h>\n\n\nnew()\n\n\nmain"]


def test_output_verdicts(spark):
    outputs = spark.createDataFrame([("f", "O0", '{"a":1.0}'), ("f", "O1", ""), ("f", "O2", "{")], "func string, opts string, observed string")
    expected = spark.createDataFrame([("f", '{"a":1.0,"b":2}')], "func string, expected string")
    assert {r.opts: r.flag_run for r in evaluation.output_verdicts(outputs, expected).collect()} == {"O0": 1, "O1": 0, "O2": 0}
