"""Arrow UDFs that run once per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.types import DataType

# Text that a result several times its size is made from at once.
SLICE_BYTES = 1 << 20
# Rows of at most a few thousand ids whose results are made at once.
ROWS_AT_ONCE = 256


def arrow_function(function: Callable[..., pa.Array], returns: str | DataType):
    """``function`` over whole Arrow columns.

    Marked non-deterministic: the optimizer would otherwise copy the call into
    every filter on its result and run it again for each.
    """
    return F.arrow_udf(function, returns).asNondeterministic()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of rows of a text column with at most ``most`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, before = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield texts.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def sliced_function(function: Callable[[pa.Array], pa.Array], returns: str | DataType):
    """``function`` over slices of a text column, for results larger than their text.

    Each slice's result is sent before the next is made, so a worker holds its
    batch of texts and one slice's result, whatever number of rows a batch has.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from map(function, slices(texts))

    return F.arrow_udf(run, returns, ArrowUDFType.SCALAR_ITER).asNondeterministic()


def pieced_function(function: Callable[..., pa.Array], returns: str | DataType, rows: int = ROWS_AT_ONCE):
    """``function`` over runs of ``rows`` rows of Arrow columns, each result sent before the next is made."""

    def run(batches: Iterator[pa.Array | tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for start in range(0, len(columns[0]), rows):
                yield function(*(column.slice(start, rows) for column in columns))

    return F.arrow_udf(run, returns, ArrowUDFType.SCALAR_ITER).asNondeterministic()


def text_function(convert: Callable[[str], str | None]):
    """``convert`` over a text column; null stays null.

    A value that cannot be converted gives null and stops nothing: text that is
    no document, one nested deeper than the parser goes, and a result that is
    not valid Unicode, such as a lone surrogate.
    """

    def guarded(text: str | None) -> str | None:
        try:
            out = None if text is None else convert(text)
            if out is not None and not out.isascii():
                out.encode()
            return out
        except (ValueError, RecursionError):
            return None

    def render(texts: pa.Array) -> pa.Array:
        return pa.array([guarded(t) for t in texts.to_pylist()], pa.string())

    return arrow_function(render, "string")
