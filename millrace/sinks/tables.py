"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_canonical(
    samples: DataFrame, path: str, folder: str = "folder", file_name: str = "file_name", mode: str = "overwrite"
) -> None:
    """Canonical JSON lines, below one folder per source folder and in it per input file.

    ``samples`` has ``canonical``, the folder and the file name. The folder of an
    input is named by ``canonical_name``; a rerun replaces what was written.
    """
    rows = samples.select(F.col("canonical").alias("value"), folder, canonical_name(folder, file_name).alias("source"))
    rows.write.partitionBy(folder, "source").mode(mode).option("compression", "none").text(path)


def canonical_name(folder: str = "folder", file_name: str = "file_name") -> Column:
    return F.concat_ws("_", folder, file_name)


def shard_name(part: str = "part", split: str = "split") -> Column:
    """Name of a packed shard: part, then the slice number in five digits."""
    return F.concat(
        F.lit("part-"), F.col(part).cast("string"), F.lit("-"), F.lpad(F.col(split).cast("string"), 5, "0")
    )


def write_packed(packed: DataFrame, path: str, part: str = "part", split: str = "split") -> None:
    """Packed rows partitioned by part and split, buffers in shuffled order.

    Rows are already spread by buffer, so a large unit is written by many tasks.
    """
    packed.withColumn("shard", shard_name(part, split)).write.mode("overwrite").partitionBy(part, split).parquet(path)


def write_merged(lines: DataFrame, path: str, name: str, order: Sequence[str]) -> None:
    """The lines (``value``) of many small files in as many files as there are tasks, each after its file's name and a tab.

    A file for each name costs a folder listing and an open file for every one
    of them, however few lines it has. All lines of a name go to one merged file,
    in ``order``. A name holds no tab and no line break; ``read_lines`` reads this with ``merged``.
    """
    placed = lines.repartition(name).sortWithinPartitions(name, *order)
    placed.select(F.concat(F.col(name), F.lit("\t"), F.col("value")).alias("value")).write.text(path)


def report_lines(metrics: DataFrame, label: str, columns: Sequence[tuple[str, str]], key: str = "opts") -> Column:
    """Report text of a metric row: level, then each value with four decimals.

    ``columns`` pairs the printed name with the value column.
    """
    pieces = [F.format_string(f"{name}:%.4f", F.col(column)) for name, column in columns]
    return F.concat_ws(" ", F.lit(label), F.concat(F.lit("opt:"), F.col(key)), *pieces)


def append_report(metrics: DataFrame, path: str) -> None:
    """Append metric rows to the report table."""
    metrics.write.mode("append").parquet(path)


def write_success_list(chunks: DataFrame, path: str) -> None:
    """Success ids, one JSON run per line in chunk order, below their level."""
    rows = chunks.repartitionByRange("opts", "chunk").sortWithinPartitions("opts", "chunk")
    rows.write.mode("overwrite").partitionBy("opts").json(path)


def append_generated(inputs: DataFrame, generated: DataFrame, keys: Sequence[str], path: str) -> None:
    """Append input rows joined with their generated text."""
    inputs.join(generated, list(keys)).write.mode("append").json(path)


def write_stage_texts(texts: DataFrame, path: str) -> None:
    """Texts and outputs by level, keyed by ``func``, ``opts`` and ``stage``."""
    texts.write.mode("append").partitionBy("opts").parquet(path)


def read_stage_texts(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("stage") == stage).drop("stage")
