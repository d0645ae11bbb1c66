"""Spans of pattern matches as Column expressions.

A span is (kind, start, stop) in code points, stop exclusive; kind is the place
of its name in a list of kinds. Matches are leftmost and non-overlapping. The
patterns given here consume possessively, so no text of any length makes them
back-track over what they have read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:int,start:bigint,stop:bigint>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def matches(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column] | None, when: Column) -> Column:
    """Spans of the matches of ``pattern`` that are ``valid``, in order; the text is only searched ``when`` that holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["match"])
        span = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), stop.alias("stop")))
        keep = F.lit(True) if valid is None else valid(pair["match"])
        return F.struct(stop.alias("at"), F.when(keep, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("match"))
    pairs = F.filter(pairs, lambda p: p["match"].isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), no_spans().alias("spans"))
    spans = F.aggregate(pairs, start, step, lambda state: state["spans"])
    return F.when(when, spans).otherwise(no_spans())


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def by_start(spans: Column) -> Column:
    """``spans`` by start, then kind."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.transform(
        F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    )


def rendered(spans: Column, kinds: Sequence[str]) -> Column:
    """``spans`` as kind:start:end, joined by commas, in the order they have."""
    names = F.array(*[F.lit(kind) for kind in kinds])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")),
        ),
        ",",
    )
