"""JSON held as text: canonical columns, Python-style rendering, comparison."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrow import arrow_function, text_function
from millrace.functions.text import strip

# The serialised columns and the descriptive keys of the prompts.
METADATA_KEYS = ("instruction set architecture", "bit width", "compiler optimization level")
NESTED_COLUMNS = ("data", "assemgraph_com", "assemgraph")
DATA_KEYS = {
    "stack variables (size and relative offset)": "param",
    "read-only constants (size and value)": ".rodata",
    "initialized global/static data (size and initial value)": ".data",
    "uninitialized global/static data (size and count)": ".bss",
}
GRAPH_KEYS = {
    "cfg_blocks (names and corresponding instructions)": "nodes",
    "edges between two connected cfg_blocks": "edges",
    "cfg_block count": "nodenum",
}


def is_falsy(document: str | Column, path: str) -> Column:
    """Whether the value at ``path`` is absent, null, empty, zero or false."""
    compact = F.to_json(F.variant_get(F.try_parse_json(document), path, "variant"))
    empty = compact.isin("null", "{}", "[]", '""', "false") | compact.rlike(r"^-?0(\.0*)?(E-?\d+)?$")
    return F.coalesce(empty, F.lit(True))


def python_json(document: str | Column, ascii_only: bool = True) -> Column:
    """Re-serialise with ``", "`` and ``": "``; ``ascii_only`` escapes the rest.

    Number forms and key order are the parser's, which SQL JSON functions do not
    keep, so this step is an Arrow-batched UDF. Text that is not JSON gives null.
    """

    return text_function(lambda text: json.dumps(json.loads(text), ensure_ascii=ascii_only))(document)


def python_object(fields: Mapping[str, str]) -> Column:
    """A JSON object of text columns under the given names, in order."""
    names = list(fields)

    def render(*columns: pa.Array) -> pa.Array:
        rows = zip(*[column.to_pylist() for column in columns])
        return pa.array([json.dumps(dict(zip(names, row))) for row in rows], pa.string())

    return arrow_function(render, "string")(*fields.values())


def _selector(keys: Mapping[str, str], defaults: Mapping[str, object]):
    def convert(text):
        document = json.loads(text)
        if not isinstance(document, dict):
            return None
        known = {**defaults, **document}
        if not all(key in known for key in keys.values()):
            return None
        return json.dumps({name: known[key] for name, key in keys.items()})

    return text_function(convert)


def data_mapping(document: str | Column, keys: Mapping[str, str] = DATA_KEYS) -> Column:
    """Data mapping under its prompt keys; null when a key is missing."""
    return _selector(keys, {})(document)


def graph_mapping(
    document: str | Column, keys: Mapping[str, str] = GRAPH_KEYS, default_edges: bool = False
) -> Column:
    """Graph under its prompt keys; optionally an absent edge list is ``[]``."""
    return _selector(keys, {"edges": []} if default_edges else {})(document)


def metadata_json(arch: str = "arch", mode: str = "mode", opts: str = "opts") -> Column:
    """Architecture, bit width and optimisation level as JSON."""
    return python_object(dict(zip(METADATA_KEYS, (arch, mode, opts))))


def canonical_lines(lines: DataFrame, raw: str = "value", keep: Sequence[str] = (), stripped: bool = False) -> DataFrame:
    """Each non-blank line as ``canonical`` sample object, or as ``rejected`` text.

    Nested columns become text so that every row has one type, and an absent
    ``asm_obj`` becomes the empty string. A line that is not a JSON object is
    rejected, as is one that is nested too deeply to parse, and one that holds
    half of a surrogate pair, which no text column can. Lines that are ``stripped``
    and not blank, as ``read_lines`` gives them, are taken as they are.
    """

    def convert(text):
        row = json.loads(text)
        if not isinstance(row, dict):
            return None
        for name in NESTED_COLUMNS:
            if name in row:
                row[name] = json.dumps(row[name], ensure_ascii=False)
        row.setdefault("asm_obj", "")
        return json.dumps(row, ensure_ascii=False)

    if not stripped:
        lines = lines.withColumn(raw, strip(raw)).filter(F.length(raw) > 0)
    rewritten = lines.withColumn("canonical", text_function(convert)(F.col(raw)))
    return rewritten.select(*keep, "canonical", F.when(F.col("canonical").isNull(), F.col(raw)).alias("rejected"))


def canonical(
    lines: DataFrame, raw: str = "value", keep: Sequence[str] = (), stripped: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Canonical sample objects, and the rejected lines."""
    both = canonical_lines(lines, raw, keep, stripped)
    good = both.filter(F.col("canonical").isNotNull()).drop("rejected")
    return good, both.filter(F.col("canonical").isNull()).drop("canonical")


def wrap_strings(document: str | Column) -> Column:
    """Flat object text with each string value as a one-element list.

    Lists stay, an empty object stays, any other value type gives null so the
    row can go to quarantine.
    """

    def convert(text):
        row = json.loads(text)
        if not isinstance(row, dict) or not all(isinstance(v, (str, list)) for v in row.values()):
            return None
        return json.dumps({k: [v] if isinstance(v, str) else v for k, v in row.items()}, ensure_ascii=False)

    return text_function(convert)(document)


def _same(observed, expected) -> bool:
    pending = [(observed, expected)]
    while pending:
        seen, wanted = pending.pop()
        if type(seen) is not type(wanted):
            return False
        if isinstance(seen, dict):
            if not seen.keys() <= wanted.keys():
                return False
            pending.extend((value, wanted[key]) for key, value in seen.items())
        elif isinstance(seen, list):
            if len(seen) != len(wanted):
                return False
            pending.extend(zip(seen, wanted))
        elif isinstance(seen, float):
            if not math.isclose(seen, wanted):
                return False
        elif seen != wanted:
            return False
    return True


def same_output(observed: str | Column, expected: str | Column) -> Column:
    """Whether observed JSON matches expected JSON.

    Types must agree, lists match item by item, observed keys must all be
    expected, and floats are close to a relative 1e-9. Empty text is compared as
    text, as an empty output file is; text that is not JSON, or nested too
    deeply to parse, gives null.
    """

    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        def parsed(text):
            return json.loads(text) if text else text

        out = []
        for seen, wanted in zip(left.to_pylist(), right.to_pylist()):
            try:
                out.append(_same(parsed(seen), parsed(wanted)))
            except (ValueError, RecursionError):
                out.append(None)
        return pa.array(out, pa.bool_())

    return arrow_function(compare, "boolean")(observed, expected)
