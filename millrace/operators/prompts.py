"""Prompt rendering: templates filled from sample columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import templates
from millrace.functions.jsontext import data_mapping, graph_mapping, metadata_json, python_object
from millrace.operators.filters import node_count

SOURCE_COLUMNS = (
    "arch",
    "mode",
    "opts",
    "sourcecode",
    "asm_obj",
    "asm_ida_com",
    "asm_ida",
    "pscode",
    "data",
    "assemgraph_com",
    "assemgraph",
)


def fill(template: str, slots: dict[str, str | Column]) -> Column:
    """``template`` with each ``{name}`` replaced by its column; null if one is null."""
    pieces = re.split(r"\{(\w+)\}", template)
    filled = []
    for index, piece in enumerate(pieces):
        if index % 2 == 0:
            if piece:
                filled.append(F.lit(piece))
        else:
            value = slots[piece]
            filled.append(F.col(value) if isinstance(value, str) else value)
    return F.concat(*filled)


def with_prompt(
    samples: DataFrame,
    template: str = "plain",
    prompt: str = "prompt",
    graph: str = "assemgraph_com",
    assembly: str = "asm_ida_com",
    data: str = "data",
) -> DataFrame:
    """Add the prompt: the assembly for one block, the graph for more.

    The prompt is null where the graph has no blocks or a part is missing or
    not JSON; ``split_unusable`` sends those rows to quarantine.
    """
    single, several = templates.TEMPLATES[template]
    filled = samples.withColumn("_data", data_mapping(data)).withColumn("_graph", graph_mapping(graph))
    slots = {"assembly": assembly, "data": "_data", "graph": "_graph"}
    if "{info}" in single:
        filled = filled.withColumn("_info", metadata_json())
        slots["info"] = "_info"
    blocks = node_count(graph)
    text = F.when(blocks == 1, fill(single, slots)).when(blocks > 1, fill(several, slots))
    return filled.withColumn(prompt, text).drop("_data", "_graph", "_info")


def with_disassembly_prompt(
    samples: DataFrame, prompt: str = "prompt", assembly: str = "comassem", graph: str = "assemgraph"
) -> DataFrame:
    """Older prompt: one object with the assembly, one with the graph."""
    columns = ("arch", "mode", "opts", assembly)
    parts = samples.withColumn(
        "_assembly", python_object(dict(zip(templates.DISASSEMBLY_KEYS, columns)))
    ).withColumn("_graph", graph_mapping(graph, templates.DISASSEMBLY_GRAPH_KEYS))
    text = fill(templates.DISASSEMBLY_TEMPLATE, {"assembly": "_assembly", "graph": "_graph"})
    return parts.withColumn(prompt, text).drop("_assembly", "_graph")


def with_slot_prompt(
    samples: DataFrame,
    template: str,
    prompt: str = "prompt",
    assembly: str = "asm_ida_com",
    assembly_other: str = "asm_ida_con",
    graph: str = "assemgraph_com",
    graph_other: str = "assemgraph_con",
    data: str = "data",
) -> DataFrame:
    """Oldest prompt: a caller's template over six slots; absent edges are ``[]``.

    Slots are ``assembly_info``, ``assembly_prompt``, ``assembly_ida_con``,
    ``cfg_prompt``, ``cfg_con`` and ``data_mapping``.
    """
    parts = samples.select(
        "*",
        metadata_json().alias("_info"),
        graph_mapping(graph, templates.SLOT_GRAPH_KEYS, default_edges=True).alias("_graph"),
        graph_mapping(graph_other, templates.SLOT_GRAPH_KEYS, default_edges=True).alias("_graph_other"),
        data_mapping(data, templates.SLOT_DATA_KEYS).alias("_data"),
    )
    slots = {
        "assembly_info": "_info",
        "assembly_prompt": assembly,
        "assembly_ida_con": assembly_other,
        "cfg_prompt": "_graph",
        "cfg_con": "_graph_other",
        "data_mapping": "_data",
    }
    text = fill(template, slots)
    return parts.withColumn(prompt, text).drop("_info", "_graph", "_graph_other", "_data")


def split_unusable(rows: DataFrame, column: str = "prompt") -> tuple[DataFrame, DataFrame]:
    """Rows with a value in ``column``, and the quarantined rest."""
    return rows.filter(F.col(column).isNotNull()), rows.filter(F.col(column).isNull())


def without_source_columns(tokenised: DataFrame) -> DataFrame:
    """Drop the text columns after tokenising; scans below then skip unused ones."""
    return tokenised.drop(*SOURCE_COLUMNS)
