"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.jsontext import is_falsy

IGNORE_INDEX = -100


def by_bit_width(df: DataFrame, bits: str, column: str = "mode") -> DataFrame:
    """Rows of one bit width; widths are text and compared as text."""
    return df.filter(F.col(column) == F.lit(str(bits)))


def node_count(graph: str | Column) -> Column:
    """Number of blocks as a double; null where the graph has no number of them."""
    return F.get_json_object(graph, "$.nodenum").try_cast("double")


def with_real_graph(df: DataFrame, graph: str = "assemgraph") -> DataFrame:
    """Drop functions whose control-flow graph is a single block.

    Rows without a number of blocks are in ``unreadable_graphs`` instead.
    """
    return df.filter(node_count(graph) != 1)


def unreadable_graphs(df: DataFrame, graph: str = "assemgraph") -> DataFrame:
    """The rows that the graph test cannot judge, for the quarantine."""
    return df.filter(node_count(graph).isNull())


def with_real_data(df: DataFrame, data: str = "data") -> DataFrame:
    """Drop functions with neither read-only nor initialised data.

    Rows whose text is not JSON are in ``unreadable_data`` instead.
    """
    return df.filter(~(is_falsy(data, "$['.rodata']") & is_falsy(data, "$['.data']")))


def unreadable_data(df: DataFrame, data: str = "data") -> DataFrame:
    """The rows that the data test cannot judge, for the quarantine."""
    return df.filter(F.try_parse_json(data).isNull())


def trainable_length(df: DataFrame, ids: str = "input_ids", length: str = "seq_length") -> DataFrame:
    return df.filter((F.col(length) > 1) & (F.size(ids) > 1))


def present(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def masked_count(labels: str | Column, ignore_index: int = IGNORE_INDEX) -> Column:
    return F.size(F.filter(labels, lambda label: label == ignore_index))


def within_label_budget(df: DataFrame, labels: str = "labels", budget: int = 2500) -> DataFrame:
    """Rows with fewer than ``budget`` masked labels after truncation."""
    return df.filter(masked_count(labels) < budget)


def position_range(
    df: DataFrame, start: int, count: int, interval: int = 100, limit: int | None = None, pos: str = "pos"
) -> DataFrame:
    """Rows of ``count`` intervals from interval ``start``, cut off at ``limit`` if there is one."""
    first, last = start * interval, (start + count) * interval
    if limit is not None:
        last = min(last, limit)
    return df.filter((F.col(pos) >= first) & (F.col(pos) < last))


def generated_only(df: DataFrame, generated: str) -> tuple[DataFrame, DataFrame]:
    """Rows with generated text, and per level how many had none."""
    empty = F.coalesce(F.length(generated), F.lit(0)) == 0
    skipped = df.groupBy("opts").agg(F.count_if(empty).alias("skipped"))
    return df.filter(~empty), skipped


def all_masked(labels: str | Column, ignore_index: int = IGNORE_INDEX) -> Column:
    """Whether the distinct labels are exactly the ignore marker."""
    return F.array_distinct(labels) == F.array(F.lit(ignore_index))


def drop_masked_oversize(
    df: DataFrame, max_length: int, ids: str = "input_ids", labels: str = "labels", strict: bool = False
) -> DataFrame:
    """Drop rows longer than ``max_length`` whose truncated labels are all masked."""
    bad = (F.size(ids) > max_length) & all_masked(F.slice(labels, 1, max_length))
    if strict:
        message = F.format_string(f"row of %d tokens has only {IGNORE_INDEX} labels", F.size(ids))
        return df.filter(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return df.filter(~bad)
