"""Chat logs: rendering, turn limits, and training rows with assistant labels.

Input is a long table of turns (``conv_id, turn, role, text``). A conversation
may be a third of all turns, so positions and token totals come from
``with_positions``; only turns that fit into ``max_length`` are ever grouped,
and every turn is at least a few tokens, which bounds those groups.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip
from millrace.functions.tokenizers import ByteTokenizer
from millrace.operators.filters import IGNORE_INDEX
from millrace.operators.ordered import id_bucket, with_positions

# The system text, role names and special marks of the template.
SYSTEM = (
    "A chat between a curious human and an artificial intelligence assistant. "
    "The assistant gives helpful, detailed, and polite answers to the human's questions.\n\n"
)
ROLES = ("Human", "Assistant")
SEPARATORS = {"llama2": ("<s>", "</s>"), "llama3": ("<|begin_of_text|>", "<|eot_id|>")}
CHAT_ROLES = ("", "Human", "Assistant")

ROLE_NAMES = {"human": "Human", "assistant": "Assistant"}
TURN_BUCKET = 1 << 14


def map_roles(turns: DataFrame, names: Mapping[str, str] = ROLE_NAMES, role: str = "role") -> DataFrame:
    """Add ``speaker``: the template's role name, null for an unsupported role."""
    lowered = F.lower(role)
    speaker = F.lit(None).cast("string")
    for name, label in names.items():
        speaker = F.when(lowered == name, F.lit(label)).otherwise(speaker)
    return turns.withColumn("speaker", speaker)


def split_roles(mapped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with a supported role, and the quarantined others."""
    return mapped.filter(F.col("speaker").isNotNull()), mapped.filter(F.col("speaker").isNull())


def split_conversations(mapped: DataFrame, conv_id: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """Conversations in which every role is supported, and the others, whole."""
    unsupported = mapped.filter(F.col("speaker").isNull()).select(conv_id).distinct()
    return mapped.join(unsupported, conv_id, "left_anti"), mapped.join(unsupported, conv_id, "left_semi")


def rendered_turn(speaker: str | Column, text: str | Column, separators: tuple[str, str], ended: str = "") -> Column:
    """``role: <bos>text<eos>``; an empty or null text leaves the slot open."""
    speaker = F.col(speaker) if isinstance(speaker, str) else speaker
    text = F.col(text) if isinstance(text, str) else text
    start, end = separators
    opened = F.concat(speaker, F.lit(": "), F.lit(start))
    return F.when(F.length(text) > 0, F.concat(opened, text, F.lit(end + ended))).otherwise(opened)


def numbered_turns(turns: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Add the turn's position ``pos`` and the conversation's ``turns``."""
    by_turn = bucket if bucket is not None else id_bucket("turn", TURN_BUCKET)
    return with_positions(turns, ["conv_id"], ["turn"], by_turn, "pos", count="turns")


def render_segments(
    turns: DataFrame,
    template: str = "llama3",
    system: str = SYSTEM,
    limit: int | None = None,
    saved: bool = False,
) -> DataFrame:
    """The rendered conversation, one ``segment`` per turn in ``pos`` order.

    The system text leads the first segment, and the segments joined are the
    prompt; a conversation of any size stays in pieces. ``limit`` keeps the
    first turns, and ``saved`` ends each non-empty turn with a newline.
    """
    segment = rendered_turn("speaker", "text", SEPARATORS[template], "\n" if saved else "")
    led = F.when(F.col("pos") == 0, F.concat(F.lit(system), segment)).otherwise(segment)
    numbered = numbered_turns(turns)
    kept = numbered if limit is None else numbered.filter(F.col("pos") < limit)
    return kept.select("conv_id", "pos", led.alias("segment"))


def render_messages(
    messages: str | Column, template: str = "llama3", system: str = SYSTEM, limit: int | None = None, saved: bool = False
) -> Column:
    """The prompt of an array of ``(role, message)`` structs held in one row."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    kept = messages if limit is None else F.slice(messages, 1, limit)
    pieces = F.transform(
        kept, lambda m: rendered_turn(m["role"], m["message"], SEPARATORS[template], "\n" if saved else "")
    )
    return F.concat(F.lit(system), F.array_join(pieces, ""))


def append_message(messages: str | Column, role: str | Column, message: str | Column) -> Column:
    """The messages with one more ``(role, message)`` pair."""
    pair = F.struct(
        (F.col(role) if isinstance(role, str) else role).alias("role"),
        (F.col(message) if isinstance(message, str) else message).alias("message"),
    )
    return F.array_append(messages, pair)


def no_messages() -> Column:
    return F.array().cast("array<struct<role:string,message:string>>")


def as_record(messages: str | Column, template: str = "llama3", system: str = SYSTEM, offset: int = 0) -> Column:
    """The conversation state as one struct."""
    return F.struct(
        F.lit(system).alias("system"),
        F.array(*[F.lit(role) for role in ROLES]).alias("roles"),
        (F.col(messages) if isinstance(messages, str) else messages).alias("messages"),
        F.lit(offset).alias("offset"),
        F.array(*[F.lit(mark) for mark in SEPARATORS[template]]).alias("seps"),
    )


def chat_turn(role: Column, message: Column, roles: tuple[str, str, str] = CHAT_ROLES) -> Column:
    """One turn of the inference prompt; the first role is the system's."""
    return F.when(role == roles[0], F.concat(F.lit("<s>"), message, F.lit("\n\n"))).otherwise(
        rendered_turn(role, message, SEPARATORS["llama2"])
    )


def chat_prompt(
    query: str | Column, history: str | Column | None = None, roles: tuple[str, str, str] = CHAT_ROLES
) -> Column:
    """History, the stripped query and an open assistant slot as one text."""
    asked = F.concat(
        chat_turn(F.lit(roles[1]), strip(query), roles),
        chat_turn(F.lit(roles[2]), F.lit(None).cast("string"), roles),
    )
    if history is None:
        return asked
    history = F.col(history) if isinstance(history, str) else history
    said = F.transform(
        F.coalesce(history, no_messages()), lambda m: chat_turn(m["role"], m["message"], roles)
    )
    return F.concat(F.array_join(said, ""), asked)


def _label(speaker: str | Column) -> Column:
    return F.concat(F.col(speaker) if isinstance(speaker, str) else speaker, F.lit(": "))


def turn_tokens(tokenizer, text: str = "text") -> Column:
    """Tokens of a rendered turn without the system text.

    The text stands between special tokens, so the pieces' lengths add up.
    """
    spoken = F.when(F.length(text) > 0, tokenizer.count(text) + 1).otherwise(F.lit(0))
    return (tokenizer.count(_label("speaker")) + 1 + spoken).cast("bigint")


def fitting_turns(
    turns: DataFrame, max_length: int = 4096, tokenizer=None, system: str = SYSTEM
) -> DataFrame:
    """Turns of the longest prefix of turn pairs that fits, with ``target_turns``.

    An odd last turn is dropped first. A prefix fits with ``max_length - 1``
    tokens, one being left for the leading mark. Conversations where not even
    one pair fits have no rows.
    """
    tokenizer = tokenizer or ByteTokenizer()
    placed = with_positions(
        turns.withColumn("tokens", turn_tokens(tokenizer)),
        ["conv_id"],
        ["turn"],
        id_bucket("turn", TURN_BUCKET),
        "pos",
        running={"total": "tokens"},
        count="turns",
    )
    paired = F.col("pos") < F.col("turns") - F.pmod("turns", F.lit(2))
    # Before the system text is counted: leaves under max_length turns per
    # conversation, so the windows below are over bounded groups.
    near = placed.filter(paired & (F.col("total") <= max_length - 1))
    conversation = Window.partitionBy("conv_id")
    opening = F.first("speaker").over(conversation.orderBy("pos"))
    led = near.withColumn("_opening", _label(opening)).withColumn(
        "total",
        F.col("total") + tokenizer.count(F.concat(F.lit(system), F.col("_opening"))) - tokenizer.count("_opening"),
    )
    # Totals only grow, so the turns that fit are the first ones.
    fits = led.filter(F.col("total") <= max_length - 1)
    counted = fits.withColumn("target_turns", F.floor(F.count(F.lit(1)).over(conversation) / 2))
    return counted.filter(F.col("pos") < 2 * F.col("target_turns")).drop("_opening")


def turn_limits(turns: DataFrame, max_length: int = 4096, tokenizer=None, system: str = SYSTEM) -> DataFrame:
    """Pairs kept per conversation and their tokens; 0 pairs where none fits."""
    kept = fitting_turns(turns, max_length, tokenizer, system)
    limits = kept.groupBy("conv_id").agg(
        F.max("target_turns").alias("target_turns"), F.max("total").alias("prompt_tokens")
    )
    everyone = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("all_turns"))
    return everyone.join(limits, "conv_id", "left").select(
        "conv_id", "all_turns", F.coalesce("target_turns", F.lit(0)).alias("target_turns"), "prompt_tokens"
    )


def chat_training_rows(
    turns: DataFrame,
    max_length: int = 4096,
    tokenizer=None,
    system: str = SYSTEM,
    ignore_index: int = IGNORE_INDEX,
    category: str | None = None,
) -> DataFrame:
    """One row per conversation: ids, labels, length, checks and category.

    The ids are the rendered prefix after one more leading mark. Marks alternate
    between the sides, starting with the human unless the assistant speaks
    first; labels are kept from each assistant mark to its end mark. Where the
    marks do not come out as one pair per turn pair, or nothing fits, all
    columns are null. ``category`` names a column of the turns.
    """
    tokenizer = tokenizer or ByteTokenizer()
    kept = fitting_turns(turns, max_length, tokenizer, system)
    head = F.when(F.col("pos") == 0, F.concat(F.lit(system), _label("speaker"))).otherwise(_label("speaker"))
    body = F.when(
        F.length("text") > 0, F.concat(tokenizer.encode("text"), F.array(F.lit(tokenizer.eos)))
    ).otherwise(F.array().cast("array<int>"))
    ids = F.concat(tokenizer.encode(head), F.array(F.lit(tokenizer.bos)), body)
    members = F.sort_array(F.collect_list(F.struct("pos", "ids", "speaker")))
    rows = kept.withColumn("ids", ids).groupBy("conv_id").agg(members.alias("_members"), F.max("target_turns").alias("target_turns"))
    first_side = F.when(F.col("_members")[0]["speaker"] == ROLES[0], F.lit(1)).otherwise(F.lit(0))

    def marks(token: int) -> Column:
        """Positions of every second ``token``, the human's skipped."""
        places = F.filter(
            F.transform(F.col("_ids"), lambda t, i: F.when(t == token, i)), lambda i: i.isNotNull()
        )
        return F.filter(places, lambda place, i: F.pmod(i, F.lit(2)) == F.col("_skip"))

    flat = rows.select(
        "conv_id",
        "target_turns",
        F.flatten(F.transform("_members", lambda m: m["ids"])).alias("_ids"),
        first_side.alias("_skip"),
    )
    marked = flat.withColumn("_starts", marks(tokenizer.bos)).withColumn("_ends", marks(tokenizer.eos))
    named = F.min_by(category, "turn") if category else F.lit("None")
    everyone = turns.groupBy("conv_id").agg(F.min("turn").alias("_first"), named.alias("_category"))
    joined = everyone.join(marked, "conv_id", "left")
    matched = (F.size("_starts") == F.col("target_turns")) & (F.size("_ends") == F.col("target_turns"))
    # With the leading mark every position is one further on.
    spans = F.arrays_zip("_starts", "_ends")
    labels = F.transform(
        "input_ids",
        lambda token, i: F.when(
            F.exists("_spans", lambda s: (i >= s["_starts"] + 1) & (i <= s["_ends"] + 1)), token
        ).otherwise(F.lit(ignore_index)),
    )
    built = (
        joined.withColumn("input_ids", F.when(matched, F.concat(F.array(F.lit(tokenizer.bos)), F.col("_ids"))))
        .withColumn("_spans", F.when(matched, spans))
        .withColumn("labels", labels)
        .withColumn("seq_length", F.when(matched, F.size("input_ids")))
    )
    seen = F.transform("labels", lambda label: F.when(label == ignore_index, F.lit(tokenizer.unk)).otherwise(label))
    return built.select(
        "conv_id",
        "input_ids",
        "labels",
        tokenizer.decode(F.col("input_ids")).alias("inputs_decode"),
        tokenizer.decode(seen).alias("labels_decode"),
        "seq_length",
        F.when(matched, F.coalesce("_category", F.lit("None"))).alias("seq_category"),
    )
