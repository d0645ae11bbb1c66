"""Prompt and target to ids, labels and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.tokenizers import ID_BYTES, ByteTokenizer, encode_packed, packed_ids
from millrace.operators.filters import IGNORE_INDEX, trainable_length

MAX_LENGTH = 4096
LABEL_BUDGET = 2500


def masked_labels(ids: Column, masked: Column, ignore_index: int = IGNORE_INDEX) -> Column:
    """``ids`` with its first ``masked`` entries replaced by the ignore marker."""
    size = F.size(ids)
    hidden = F.least(masked, size)
    return F.concat(F.array_repeat(F.lit(ignore_index), hidden), F.slice(ids, hidden + 1, size))


def tokenise(
    rows: DataFrame,
    prompt: str = "prompt",
    target: str = "sourcecode",
    tokenizer=None,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Add ``input_ids``, ``labels``, ``seq_length`` and ``source_length``.

    The prompt and the prompt with its target are encoded separately, as a
    tokenizer may join text across their border. Labels of the prompt are
    masked unless it is empty; both arrays are cut to ``max_length``.
    """
    tokenizer = tokenizer or ByteTokenizer()
    sequence = F.concat(F.col(prompt), F.col(target))
    encoded = rows.withColumn("_encoded", tokenizer.encode(sequence, max_length))
    if "source_length" not in rows.columns:
        encoded = encoded.withColumn("source_length", F.lit(1) + tokenizer.count(prompt))
    # The cut comes first, so that no later array is longer than max_length.
    body = F.slice("_encoded", 1, max_length - 1)
    ids = F.slice(F.concat(F.array(F.lit(tokenizer.bos)), body, F.array(F.lit(tokenizer.eos))), 1, max_length)
    hidden = F.when(F.length(prompt) == 0, F.lit(0)).otherwise(F.col("source_length"))
    return (
        encoded.withColumn("input_ids", ids)
        .withColumn("labels", masked_labels(F.col("input_ids"), hidden))
        .withColumn("seq_length", F.size("input_ids"))
        .drop("_encoded")
    )


def tokenise_packed(
    rows: DataFrame,
    prompt: str = "prompt",
    target: str = "sourcecode",
    tokenizer=None,
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Add ``input_ids``, packed, and ``seq_length``, as ``tokenise`` has them."""
    tokenizer = tokenizer or ByteTokenizer()
    body = encode_packed(tokenizer, F.concat(F.col(prompt), F.col(target)), max_length)
    first, last = F.lit(packed_ids(tokenizer.bos)), F.lit(packed_ids(tokenizer.eos))
    encoded = rows.withColumn("input_ids", F.substring(F.concat(first, body, last), 1, ID_BYTES * max_length))
    return encoded.withColumn("seq_length", (F.octet_length("input_ids") / ID_BYTES).cast("int"))


def within_budget(prompt: str, source_length: str, max_length: int, budget: int) -> Column:
    """Whether fewer than ``budget`` labels are masked.

    The masked labels are the prompt's, cut to ``max_length``, so the count
    needs no pass over the labels.
    """
    masked = F.when(F.length(prompt) == 0, F.lit(0)).otherwise(F.least(F.col(source_length), F.lit(max_length)))
    return masked < budget


def training_rows(
    rows: DataFrame,
    prompt: str = "prompt",
    target: str = "sourcecode",
    tokenizer=None,
    max_length: int = MAX_LENGTH,
    budget: int = LABEL_BUDGET,
) -> DataFrame:
    """Tokenised rows within the label budget and longer than one token.

    A tokenizer that counts without encoding lets the budget run before the
    target is encoded.
    """
    tokenizer = tokenizer or ByteTokenizer()
    counted = rows.withColumn("source_length", F.lit(1) + tokenizer.count(prompt))
    kept = counted.filter(within_budget(prompt, "source_length", max_length, budget))
    return trainable_length(tokenise(kept, prompt, target, tokenizer, max_length))
