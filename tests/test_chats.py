"""Chat rows against golden vectors."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import conversations as chats


# Byte tokens, with 256 before and 257 after a text; worked out by hand.
def said(role, words):
    return [*f"{role}: ".encode(), 256, *words.encode(), 257]


SYSTEM = [256, *b"S\n"]
HUMAN, REPLY = said("Human", "hi"), said("Assistant", "yo")
MORE, LAST = said("Human", "é"), said("Assistant", "bye now")
ANSWER = [256, *b"yo", 257]
TALKS = {
    # A pair: the reply is learned from its opening to its closing mark.
    "pair": ([("human", "hi"), ("assistant", "yo")], SYSTEM + HUMAN + REPLY, [-100] * (len(SYSTEM + HUMAN + REPLY) - 4) + ANSWER),
    # The turn without a partner falls away.
    "odd": ([("human", "hi"), ("assistant", "yo"), ("human", "x")], SYSTEM + HUMAN + REPLY, [-100] * (len(SYSTEM + HUMAN + REPLY) - 4) + ANSWER),
    # The second pair would pass the limit.
    "long": (
        [("human", "hi"), ("assistant", "yo"), ("human", "x" * 40), ("assistant", "y")],
        SYSTEM + HUMAN + REPLY,
        [-100] * (len(SYSTEM + HUMAN + REPLY) - 4) + ANSWER,
    ),
    "two": (
        [("human", "hi"), ("assistant", "yo"), ("human", "é"), ("assistant", "bye now")],
        SYSTEM + HUMAN + REPLY + MORE + LAST,
        [-100] * (len(SYSTEM + HUMAN + REPLY) - 4) + ANSWER + [-100] * (len(MORE + LAST) - 9) + [256, *b"bye now", 257],
    ),
    # Spans alternate from the first turn, whatever the later roles are.
    "reply first": (
        [("assistant", "yo"), ("human", "hi")],
        SYSTEM + REPLY + HUMAN,
        [-100] * (len(SYSTEM) + 11) + ANSWER + [-100] * len(HUMAN),
    ),
    "two replies": ([("human", "hi"), ("human", "hi")], SYSTEM + HUMAN + HUMAN, [-100] * (len(SYSTEM + HUMAN) + 7) + [256, *b"hi", 257]),
    # An empty text has no closing mark, so the marks do not pair up.
    "empty": ([("human", ""), ("assistant", "yo")], None, None),
    "too long": ([("human", "x" * 90), ("assistant", "y")], None, None),
}


def test_training_rows(spark):
    rows = [(conv, 3 * i, role, words) for conv, (turns, _, _) in enumerate(TALKS.values()) for i, (role, words) in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    good, bad = chats.split_roles(chats.map_roles(frame))
    assert bad.isEmpty()
    found = {row.conv_id: row for row in chats.chat_training_rows(good, 70, system="S\n").collect()}
    for conv, (name, (_, ids, labels)) in enumerate(TALKS.items()):
        row = found[conv]
        assert (row.input_ids, row.labels) == (ids, labels), name
        assert row.seq_length == (None if ids is None else len(ids))
        assert row.seq_category == (None if ids is None else "None")


@pytest.mark.parametrize("limit", [60, 150])
def test_labels_are_ids_of_replies(spark, limit):
    draw = random.Random(limit)
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(2, 9)):
            rows.append((conv, turn, ("human", "assistant")[turn % 2], draw.choice("abcé") * draw.randint(1, 30)))
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    good, _ = chats.split_roles(chats.map_roles(frame))
    for row in chats.chat_training_rows(good, limit).collect():
        if row.input_ids is not None:
            assert len(row.input_ids) == len(row.labels) <= limit
            assert all(label in (-100, token) for token, label in zip(row.input_ids, row.labels, strict=True))
            assert row.labels.count(257) * 2 == row.input_ids.count(257)


def test_hot_conversation_stays_bounded(spark):
    turns = spark.range(40000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000 + 1).alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "human").otherwise("assistant").alias("role"),
        F.lit("hello").alias("text"),
    )
    good, _ = chats.split_roles(chats.map_roles(turns))
    kept = chats.fitting_turns(good, 512).groupBy("conv_id").count().agg(F.max("count")).first()[0]
    assert kept <= 512
    segments = chats.render_segments(good)
    assert segments.count() == 40000


def test_role_quarantine(spark):
    frame = spark.createDataFrame([(0, 0, "HUMAN", "a"), (0, 1, "system", "b")], "conv_id int, turn int, role string, text string")
    good, bad = chats.split_roles(chats.map_roles(frame))
    assert [r.speaker for r in good.collect()] == ["Human"] and [r.role for r in bad.collect()] == ["system"]


def test_message_state(spark):
    frame = spark.createDataFrame([("q ",)], "t string")
    history = chats.append_message(chats.append_message(chats.no_messages(), F.lit(""), F.lit("be kind")), F.lit("Human"), F.lit("hi"))
    out = frame.select(chats.chat_prompt("t", history).alias("p"), chats.chat_prompt("t").alias("q"), chats.as_record(history).alias("r"),
                       chats.render_messages(history, "llama2", "S", limit=1).alias("one")).first()
    assert out.p == "<s>be kind\n\nHuman: <s>hi</s>Human: <s>q</s>Assistant: <s>"
    assert out.q == "Human: <s>q</s>Assistant: <s>"
    assert out.r.seps == ["<|begin_of_text|>", "<|eot_id|>"] and out.one == "S: <s>be kind</s>"
