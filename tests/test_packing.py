"""The histogram layout against the packing rules, row by row."""

import json
from collections import Counter
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function
from millrace.functions.tokenizers import ByteTokenizer, _packed, packed_ids
from millrace.operators import packing
from millrace.operators.ordered import id_bucket
from millrace.operators.tokens import masked_labels, tokenise, tokenise_packed
from millrace.plans.corpus import tokenised_samples


def buffers_of(lengths, capacity):
    """Shortest runs of rows that hold ``capacity`` tokens, and what is left at the end, if only nothing."""
    start = 0
    for end, total in enumerate(accumulate(lengths), 1):
        if total - sum(lengths[:start]) >= capacity:
            yield lengths[start:end], False
            start = end
    yield lengths[start:], True


def bins_of(rows, max_length):
    """Indexes of the rows in each bin of a buffer, and the bin that stays open."""
    bins, last = [], None
    for at, length in enumerate(rows):
        if length <= max_length and last is not None and sum(rows[i] for i in bins[last]) + length <= max_length:
            bins[last].append(at)
        else:
            bins.append([at])
            last = len(bins) - 1 if length <= max_length else last
    return bins, last


def fold(lengths, max_length, factor=16):
    """(buffer, bin, pos, residual) per row: the rules of the packing, buffer by buffer."""
    places = []
    for buffer, (rows, ended) in enumerate(buffers_of(lengths, max_length * factor)):
        bins, last = bins_of(rows, max_length)
        own = {at: (buffer, b, pos, b == last and not ended) for b, held in enumerate(bins) for pos, at in enumerate(held)}
        places += [own[at] for at in range(len(rows))]
    return places


def laid_out(lengths, max_length, factor=16):
    runs = sorted(Counter(lengths).items())
    by_length = {}
    for segment in packing.layout(runs, max_length, factor):
        by_length.setdefault(segment["length"], []).append(segment)
    out = []
    for length, count in runs:
        assert len(by_length[length]) <= 3
        for rank in range(count):
            (s,) = [s for s in by_length[length] if s["first"] <= rank < s["last"]]
            times, at = divmod(rank - s["first"], s["period"])
            if at < s["room"]:
                bin_, pos = s["bin"], s["members"] + at
            else:
                more, pos = divmod(at - s["room"], s["fit"])
                bin_ = s["after"] + 1 + more
            out.append((s["buffer"] + times, bin_, pos, not s["alone"] and bin_ == s["open_bin"]))
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=150), st.integers(2, 20), st.sampled_from([1, 2, 3, 16]))
def test_layout_equals_fold(lengths, max_length, factor):
    lengths = sorted(lengths)
    assert laid_out(lengths, max_length, factor) == fold(lengths, max_length, factor)


def test_layout_by_hand():
    # Buffer of 16, rows of 8: the first buffer holds 2,2,3,4,5 and ends with 5 alone.
    places = laid_out([2, 2, 3, 4, 5, 7, 9], 8, 2)
    assert places == [(0, 0, 0, False), (0, 0, 1, False), (0, 0, 2, False), (0, 1, 0, False), (0, 2, 0, True),
                      (1, 0, 0, True), (1, 1, 0, False)]


@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_plan_on_skewed_units(spark, width):
    # Unit 0 and length 40 hold most rows, and their ranks span many small buckets.
    rows = [(i, 0 if i % 3 else 1, 0, 40 if i % 2 else 1 + i % 90) for i in range(1500)]
    frame = spark.createDataFrame(rows, "row_id bigint, part int, split int, seq_length int")
    plan = packing.plan_packing(frame, 64, bucket=id_bucket("row_id", width)).collect()
    assert len(plan) == len(rows)
    for part in (0, 1):
        mine = sorted((r for r in rows if r[1] == part), key=lambda r: (r[3], r[0]))
        expected = {r[0]: place for r, place in zip(mine, fold([r[3] for r in mine], 64))}
        seen = {r.row_id: (r.buffer, r.bin, r.pos, r.residual) for r in plan if r.part == part}
        assert seen == expected


def test_pack_keeps_tokens_in_order(spark):
    rows = [(i, 0, 0, 1 + i % 9, list(range(100 * i, 100 * i + 1 + i % 9))) for i in range(300)]
    frame = spark.createDataFrame(rows, "row_id bigint, part int, split int, seq_length int, input_ids array<int>")
    frame = frame.withColumn("labels", F.col("input_ids"))
    packed = packing.pack(frame, 12, buffer_factor=4).collect()
    assert all(len(r.input_ids) <= 12 and r.input_ids == r.labels for r in packed)
    assert sorted(t for r in packed for t in r.input_ids) == sorted(t for r in rows for t in r[4])
    lost = packing.pack(frame, 12, buffer_factor=4, keep_residual=False).collect()
    assert 0 < sum(len(r.input_ids) for r in lost) < sum(len(r.input_ids) for r in packed)
    for unit in {(r.buffer) for r in packed}:
        places = sorted(r.shuffle_pos for r in packed if r.buffer == unit)
        assert places == list(range(len(places)))


def test_labels_can_be_made_after_packing(spark):
    rows = [(i, 0, 0, 1 + i % 9, list(range(1 + i % 9)), i % 5) for i in range(200)]
    schema = "row_id bigint, part int, split int, seq_length int, input_ids array<int>, hidden int"
    frame = spark.createDataFrame(rows, schema).withColumn("labels", masked_labels(F.col("input_ids"), F.col("hidden")))
    for limit in (6, 12):
        one, two = (packing.pack(frame, limit, buffer_factor=4, hidden=h).collect() for h in (None, "hidden"))
        assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_packed_ids_are_packed_as_arrays_are(spark):
    rows = [(i, 0, i % 2, 1 + i % 9, list(range(300 * i, 300 * i + 1 + i % 9)), i % 11) for i in range(200)]
    schema = "row_id bigint, part int, split int, seq_length int, input_ids array<int>, hidden int"
    frame = spark.createDataFrame(rows, schema)
    whole = frame.withColumn("input_ids", arrow_function(_packed, "binary")("input_ids"))
    for limit in (6, 12):
        one, two = (packing.pack(ids, limit, buffer_factor=4, hidden="hidden") for ids in (frame, whole))
        assert one.dtypes == two.dtypes
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    with pytest.raises(ValueError, match="masked"):
        packing.pack(whole, 6)


def test_packed_tokens_are_those_of_arrays(spark):
    class Arrays:
        bos, eos = 70_000, 70_001
        encode, count = ByteTokenizer().encode, ByteTokenizer().count

    texts = [("p", "tail"), ("", ""), ("é", "żółć" * 9), ("x" * 30, "y"), (None, "y"), ("x", None), ("x" * 14, ""), ("x" * 13, "")]
    frame = spark.createDataFrame(texts, "prompt string, sourcecode string").coalesce(1)
    for tokenizer in (ByteTokenizer(), Arrays()):
        wanted = tokenise(frame, tokenizer=tokenizer, max_length=16).select("input_ids", "seq_length").collect()
        for row, own in zip(tokenise_packed(frame, tokenizer=tokenizer, max_length=16).collect(), wanted, strict=True):
            assert row.input_ids == (None if own.input_ids is None else packed_ids(*own.input_ids))
            assert row.seq_length == (None if own.input_ids is None else own.seq_length)


def test_corpus_flow_carries_packed_ids(spark):
    graph = '{"nodes":["b0"],"edges":[[0,1]],"nodenum":1}'
    data = '{"param":[1],".rodata":"a",".data":[1],".bss":0}'
    line = {"sourcecode": "int f;", "asm_ida_com": "call f", "assemgraph_com": graph, "data": data}
    frame = spark.createDataFrame([(0, 0, 0, json.dumps(line))], "part int, split int, row_id bigint, canonical string")
    stored = tokenised_samples(frame, "plain", ByteTokenizer(), 4096, 2500)
    assert dict(stored.dtypes)["input_ids"] == "binary"
    row = stored.first()
    assert len(row.input_ids) == 4 * row.seq_length and row.dropped is None and row.rejected is None


def test_oversize_rows(spark):
    rows = [(0, 0, 0, 5, list(range(5)), [-100] * 5), (1, 0, 0, 6, list(range(6)), [-100] * 4 + [4, 5]),
            (2, 0, 0, 7, list(range(7)), [1] * 7)]
    schema = "row_id bigint, part int, split int, seq_length int, input_ids array<int>, labels array<int>"
    frame = spark.createDataFrame(rows, schema)
    packed = packing.pack(frame, 4).collect()
    assert [r.input_ids for r in packed] == [[0, 1, 2, 3]]
    with pytest.raises(Exception, match="only masked labels"):
        packing.pack(frame, 4, strict=True).collect()
