"""Fill-in-the-middle forms of texts, cut between units.

One ``fullmatch`` of ``(unit)*`` with the regex library, which keeps all
repetitions of a group, gives the ends of all units of a text at once; their
number and both cuts are read off that list. Everything else is columns.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
CUTS = "struct<n:bigint,low:bigint,high:bigint>"


def unit_ends(text: str, unit: regex.Pattern) -> list[int]:
    """The end of each unit of ``text`` in code points."""
    found = unit.fullmatch(text)
    if found is None:
        raise ValueError("units do not cover a text")
    return found.ends(1)


def cuts(unit: str):
    """Function of text and two draws: its number of units and the offsets of the lesser and the greater cut."""

    def cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        # Possessive: a unit once taken is not given back, so no alternatives are remembered.
        pattern = regex.compile(f"((?>{unit}))*+")
        rows = []
        for text, *draws in zip(texts, first.to_pylist(), second.to_pylist(), strict=True):
            ends = [0, *unit_ends(text.as_py(), pattern)]
            low, high = sorted(draw % len(ends) for draw in draws)
            rows.append((len(ends) - 1, ends[low], ends[high]))
        columns = [pa.array(values, pa.int64()) for values in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
        return pa.StructArray.from_arrays(columns, ["n", "low", "high"])

    return arrow_function(cut, CUTS)


def draws_of(doc_id: Column, seed: int) -> list[Column]:
    """Four draws from a row's id: the first 8-digit groups of a hex digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = LINE
) -> DataFrame:
    """doc_id, n, form, output, prefix_chars and middle_chars for every row of ``docs`` (doc_id, text).

    ``rate`` in 100 texts are cut, ``spm_rate`` in 100 of those begin with the
    suffix. A null text counts as empty; an empty text, and one that contains a
    mark, stays plain and has no lengths. A null id draws as empty text. Repeated
    rows give equal rows, an empty table an empty result; no other columns are read.
    """
    first, second, third, fourth = draws_of(F.col("doc_id"), seed)
    drawn = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        first.alias("first"),
        second.alias("second"),
        (third % 100 < rate).alias("wanted"),
        (fourth % 100 < spm_rate).alias("suffix_first"),
    )
    text = F.col("text")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    cut = drawn.withColumn("cut", cuts(unit)(text, F.col("first"), F.col("second")))
    form = F.when((text == "") | marked | ~F.col("wanted"), "plain").otherwise(
        F.when(F.col("suffix_first"), "spm").otherwise("psm")
    )
    formed = cut.select("doc_id", "text", "cut", form.alias("form"))
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    whole = F.length("text")
    prefix = F.substring(text, F.lit(1), low)
    middle = F.substring(text, low + 1, high - low)
    suffix = F.substring(text, high + 1, whole - high)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut_only = F.col("form") != "plain"
    return formed.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        output.alias("output"),
        F.when(cut_only, F.col("cut.low")).alias("prefix_chars"),
        F.when(cut_only, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.

    No mark begins as another or as itself ends, so each stands in an output
    exactly once, wherever its parts meet.
    """
    body = F.substring(output, 4, 2147483647)

    def between(opening: str, closing: str) -> Column:
        return F.substring_index(F.substring_index(output, opening, -1), closing, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(F.substring_index(body, SUFFIX, 1), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, F.substring_index(body, PREFIX, 1)))
        .otherwise(output)
    )


def digest(filled: DataFrame) -> DataFrame:
    """``filled`` (of ``fill_in_middle``) with hashes of output and rebuilt text in place of the output."""
    return filled.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
