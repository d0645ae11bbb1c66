"""Ids are made for a bounded slice of text at once, and not beyond what is needed."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions.arrow import SLICE_BYTES, sliced_function, slices
from millrace.functions.tokenizers import IDS, ByteTokenizer, _byte_ids
from millrace.operators.tokens import tokenise


def test_slices_hold_all_rows_in_bounded_runs():
    draw = random.Random(5)
    texts = [draw.choice([None, "", "é" * draw.randrange(40), "x" * draw.randrange(9)]) for _ in range(500)] + ["y" * 99]
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    parts = list(slices(column, 64))
    assert [t for part in parts for t in part.to_pylist()] == texts
    sizes = [sum(len((t or "").encode()) for t in part.to_pylist()) for part in parts]
    assert all(size <= 64 or len(part) == 1 for size, part in zip(sizes, parts)) and len(parts) > 50
    assert list(slices(pa.array([], pa.string()))) == []


def test_a_batch_gives_its_ids_in_bounded_pieces():
    texts = ["aé" * 2000, None, ""] * 3000
    run = sliced_function(_byte_ids, IDS).func
    found = 0
    for ids in run(iter([pa.array(texts[:4500], pa.string()), pa.array(texts[4500:], pa.string())])):
        # Four bytes an id, and offsets.
        assert pa.types.is_list(ids.type) and ids.nbytes < 5 * SLICE_BYTES
        for row in ids:
            assert row.as_py() == (None if texts[found] is None else list(texts[found].encode()))
            found += 1
    assert found == len(texts)


def test_no_more_of_a_text_is_encoded_than_is_needed(spark):
    rows = [("p", "é" * n) for n in (0, 3, 30, 100_000)]
    frame = spark.createDataFrame(rows, "prompt string, sourcecode string")
    for row in tokenise(frame, max_length=16).collect():
        whole = [256, *f"p{row.sourcecode}".encode(), 257]
        assert row.input_ids == whole[:16] and row.seq_length == min(16, len(whole))
        assert row.labels == [-100, -100, *whole[2:16]]
    sizes = frame.select(F.size(ByteTokenizer().encode("sourcecode", 16)).alias("s")).collect()
    assert [r.s for r in sizes] == [0, 6, 32, 32]
