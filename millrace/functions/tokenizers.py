"""Tokenizers: a text column in, an array of ids out.

A tokenizer has ``encode`` and ``count`` over Columns and the special ids.
``encode`` is told how many leading ids are ``needed``, and may give more. The
special tokens are added by the callers as ids, and text is always encoded
between two of them, so lengths add up across special tokens for every tokenizer.

Packed ids are one binary value, four bytes an id. Spark copies, joins and cuts
it as a whole, where it takes an array apart id by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from millrace.functions.arrow import arrow_function, pieced_function, sliced_function

IDS = ArrayType(IntegerType())
ID_TYPE, ID_BYTES = "<i4", 4


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _byte_ids(texts: pa.Array) -> pa.Array:
    # The buffers of a string array already are its UTF-8 bytes and row offsets.
    binary = texts.cast(pa.large_binary())
    offsets = pa.Array.from_buffers(pa.int64(), len(binary) + 1, [None, binary.buffers()[1]], offset=binary.offset)
    data = binary.buffers()[2]
    first = offsets[0].as_py()
    count = offsets[-1].as_py() - first
    values = pa.Array.from_buffers(pa.uint8(), count, [None, data], offset=first) if count else pa.array([], pa.uint8())
    lists = pa.LargeListArray.from_arrays(pc.subtract(offsets, first), values.cast(pa.int32()))
    if binary.null_count:
        lists = pc.if_else(binary.is_valid(), lists, pa.scalar(None, lists.type))
    return lists.cast(pa.list_(pa.int32()))


def _packed(lists: pa.Array) -> pa.Array:
    """Each array of ids as one binary value."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64) * ID_BYTES)
    values = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), ID_TYPE)
    packed = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(values)])
    if lists.null_count:
        packed = pc.if_else(lists.is_valid(), packed, pa.scalar(None, packed.type))
    return packed.cast(pa.binary())


def _unpacked(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some packed values side by side, and where each value's begin, with their end."""
    whole = values.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    ids = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(ID_TYPE) if data else np.zeros(0, ID_TYPE)
    return ids, (offsets - offsets[0]) // ID_BYTES


def packed_ids(*ids: int) -> bytes:
    return np.array(ids, ID_TYPE).tobytes()


def encode_packed(tokenizer, text: str | Column, needed: int) -> Column:
    """The packed ids of a text column, from a tokenizer that makes them or from its arrays."""
    if hasattr(tokenizer, "encode_packed"):
        return tokenizer.encode_packed(text, needed)
    return arrow_function(_packed, "binary")(tokenizer.encode(text, needed))


def joined_members(ids: str | Column, hidden: str | Column, ignore_index: int) -> Column:
    """``ids`` and ``labels`` of arrays of packed members: the members' ids in order, and the same with the
    first ``hidden`` of each member replaced by the ignore marker."""

    def join(members: pa.Array, masked: pa.Array) -> pa.Array:
        values, begins = _unpacked(members.flatten())
        lengths = np.diff(begins)
        masked = np.minimum(masked.flatten().to_numpy(zero_copy_only=False), lengths)
        marks = np.repeat(np.tile([True, False], len(lengths)), np.stack([masked, lengths - masked], axis=1).ravel())
        labels = np.where(marks, np.int32(ignore_index), values)
        counts = pc.list_value_length(members).to_numpy(zero_copy_only=False)
        offsets = pa.array(begins[np.append(0, np.cumsum(counts))], pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, pa.array(column, pa.int32())) for column in (values, labels)], ["ids", "labels"]
        )

    return pieced_function(join, "struct<ids: array<int>, labels: array<int>>")(ids, hidden)


class ByteTokenizer:
    """UTF-8 bytes as ids 0..255, then the special ids."""

    bos, eos, pad, unk = 256, 257, 258, 259

    def encode(self, text: str | Column, needed: int | None = None) -> Column:
        # A character is a byte or more.
        text = _col(text) if needed is None else F.substring(_col(text), 1, needed)
        return sliced_function(_byte_ids, IDS)(text)

    def encode_packed(self, text: str | Column, needed: int) -> Column:
        return sliced_function(lambda texts: _packed(_byte_ids(texts)), "binary")(F.substring(_col(text), 1, needed))

    def count(self, text: str | Column) -> Column:
        return F.octet_length(_col(text))

    def decode(self, ids: str | Column) -> Column:
        """Text of byte ids; the special ids have no text."""
        unk, bos, eos = self.unk, self.bos, self.eos

        def render(rows: pa.Array) -> pa.Array:
            marks = {bos: b"<s>", eos: b"</s>", unk: b"<unk>"}
            table = [bytes([i]) if i < 256 else marks.get(i, b"") for i in range(260)]

            def text(row):
                return None if row is None else b"".join(map(table.__getitem__, row)).decode("utf-8", "replace")

            return pa.array(map(text, rows.to_pylist()), pa.string())

        return arrow_function(render, "string")(ids)
