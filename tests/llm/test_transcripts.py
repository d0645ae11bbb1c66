from itertools import product

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from millrace.llm import transcripts
from millrace.llm.queries import marked_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def random_chain(seed):
    draw = np.random.default_rng(seed)
    moves = draw.random((transcripts.STATES + 1, transcripts.STATES))
    emits = draw.random((transcripts.STATES, transcripts.OBSERVATIONS))
    return transcripts.Chain(np.log(moves), np.log(emits))


def score(chain, seen, states):
    total, before = 0.0, transcripts.START
    for code, state in zip(seen, states, strict=True):
        total += chain.moves[before, state] + chain.emits[state, code]
        before = state
    return total


def test_best_path_against_all_paths(spark, monkeypatch):
    monkeypatch.setattr(transcripts, "CHUNK", 2)
    chain, draw = random_chain(1), np.random.default_rng(2)
    seen = {str(n): draw.integers(0, transcripts.OBSERVATIONS, n).tolist() for n in range(1, 7)}
    rows = [(name, line, code) for name, codes in seen.items() for line, code in enumerate(codes)]
    found = {}
    for row in transcripts.decode(spark.createDataFrame(rows, "conversation string, line long, seen int"), chain).collect():
        found.setdefault(row["conversation"], {})[row["line"]] = row["state"]
    for name, codes in seen.items():
        states = [found[name][line] for line in range(len(codes))]
        best = max(score(chain, codes, path) for path in product(range(transcripts.STATES), repeat=len(codes)))
        assert score(chain, codes, states) == pytest.approx(best)


def test_chunks_do_not_change_a_long_path(spark, monkeypatch):
    chain, draw = random_chain(3), np.random.default_rng(4)
    codes = draw.integers(0, transcripts.OBSERVATIONS, 700).tolist()
    frame = spark.createDataFrame([("a", i, c) for i, c in enumerate(codes)], "conversation string, line long, seen int")
    paths = []
    for chunk in (5, 1000):
        monkeypatch.setattr(transcripts, "CHUNK", chunk)
        rows = transcripts.decode(frame, chain).orderBy("line").collect()
        assert [row["line"] for row in rows] == list(range(700))
        paths.append(score(chain, codes, [row["state"] for row in rows]))
    assert paths[0] == pytest.approx(paths[1])


def test_roles_of_held_out_conversations(spark):
    turns = marked_turns(spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    rows = [row for row in transcripts.parsed(turns).collect() if row["held_out"]]
    assert np.mean([row["role"] == row["found_role"] for row in rows]) > 0.85


def test_canonical_form(spark):
    talk = [(1, 0, "user", "User: hi there"), (1, 1, "assistant", "Assistant: hello\nhow are you"), (1, 2, "user", "### Human:\nfine")]
    train = [(c, t, r, x) for c in range(2, 40) for _, t, r, x in talk]
    rows = transcripts.parsed(spark.createDataFrame(talk + train, SCHEMA)).filter("conv_id = 1").orderBy("line").collect()
    assert "".join(row["segment"] for row in rows) == (
        "<|user|>\nhi there<|end|>\n<|assistant|>\nhello\nhow are you<|end|>\n<|user|>\n\nfine<|end|>\n"
    )
    assert [row["found_turn"] for row in rows] == [0, 1, 1, 2, 2]


def test_odd_rows_and_empty(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, "x"), (2, 5, "tool", ""), (2, 1, "USER", "q " * 30000), (3, 0, "assistant", "\n\n")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit("x")).withColumn("seen", F.lit("x"))
    found = transcripts.parsed(frame)
    assert found.count() == 8 and not found.filter("found_role is null or segment is null").count()
    assert transcripts.parsed(frame.limit(0)).count() == 0


def test_texts_of_one_turn_stay_whole(spark):
    texts = ["alpha one\nalpha two", "beta one\nbeta two", "same\nlines", "same\nlines", None]
    rows = [(1, 0, "user", text) for text in texts] + [(1, 1, "user", "last"), (None, None, None, "x\ny"), (None, None, None, "z\nw")]
    lines = transcripts.numbered_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    by_conversation = {}
    for row in sorted(lines, key=lambda r: r["line"]):
        by_conversation.setdefault(row["conv_id"], []).append(row["text"])
    assert sorted(r["line"] for r in lines if r["conv_id"] == 1) == list(range(10))
    joined = "\n".join(by_conversation[1]) + "\n"
    for text in texts[:2]:
        assert text in joined
    assert joined.count("same\nlines\n") == 2 and by_conversation[1][-1] == "last" and "" in by_conversation[1]
    assert "\n".join(by_conversation[None]) in ("x\ny\nz\nw", "z\nw\nx\ny")


def test_a_turn_of_many_lines_is_many_tasks(spark):
    text = "\n".join(f"line {i}" for i in range(100_000))
    frame = spark.createDataFrame([(1, 0, "user", text)], SCHEMA)
    # Ranges of a few kilobytes would be joined again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = transcripts.numbered_lines(frame).withColumn("task", F.spark_partition_id())
        assert lines.groupBy("task").count().filter("count > 50000").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert lines.filter(F.col("text") != F.concat(F.lit("line "), F.col("line").cast("string"))).count() == 0


def test_unmarked_lines_of_held_out_conversations(spark):
    turns = marked_turns(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text"))
    lines = transcripts.numbered_lines(turns).select("conv_id", "line", transcripts.marker_of(F.col("text")).alias("marker"))
    found = transcripts.parsed(turns).filter("held_out").join(lines, ["conv_id", "line"]).filter("marker = 0").collect()
    # No marker tells: the chain and the lengths alone decide.
    assert len(found) > 50 and np.mean([row["role"] == row["found_role"] for row in found]) > 0.6


def test_markers_against_the_role(spark):
    talk = [(0, "user", "User: ask"), (1, "assistant", "Assistant: reply"), (2, "user", "User: more"), (3, "assistant", "Assistant: done")]
    train = [(c, *turn) for c in range(2, 60) for turn in talk]
    # The last turn is labelled user but marked as the assistant's: the marker is what a reader sees.
    asked = [(1, 0, "user", "User: ask"), (1, 1, "user", "Assistant: reply")]
    rows = transcripts.parsed(spark.createDataFrame(asked + train, SCHEMA)).filter("conv_id = 1").orderBy("line").collect()
    assert [row["found_role"] for row in rows] == ["user", "assistant"] and [row["role"] for row in rows] == ["user", "user"]
