"""Readers for the file layouts of samples, tasks and per-entity texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.jsontext import canonical
from millrace.functions.text import strip


LINE_COLUMNS = ("folder", "part", "file_name", "path", "line_no")


def _path() -> Column:
    """Path of the file as it is on disk: the metadata column holds it as a URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _path_part(from_end: int) -> Column:
    return F.element_at(F.split(_path(), "/"), -from_end)


def read_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl", merged: bool = False) -> DataFrame:
    """Stripped, non-blank lines of the files below ``folder``.

    Rows have ``value``, ``path``, ``file_name``, ``folder`` (its name), ``part``
    (the text after the folder's last underscore) and ``line_no``, which grows
    along each file: files are split between tasks at byte offsets, and the
    split's start leads. Only ``path`` tells files of one name apart.

    ``merged`` reads files of ``write_merged``, where a line begins with the name
    of the file it is from and a tab: that is its ``file_name``, and ``path`` and
    ``line_no`` are its place in the merged file. A line without a tab is one of
    the merged file itself.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    # Task-local ids grow within a split, and the split's offset orders the splits.
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    name, value = _path_part(1), F.col("value")
    if merged:
        tab = F.instr("value", "\t")
        name = F.when(tab > 0, F.substring_index("value", "\t", 1)).otherwise(name)
        value = F.substr("value", tab + 1)
    placed = lines.select(
        strip(value).alias("value"),
        name.alias("file_name"),
        _path().alias("path"),
        _path_part(2).alias("folder"),
        F.col("_metadata.file_block_start").alias("block_start"),
        in_task.alias("in_task"),
    )
    part = F.element_at(F.split("folder", "_"), -1)
    return (
        placed.withColumn("part", part)
        .withColumn("line_no", F.struct("block_start", "in_task"))
        .drop("block_start", "in_task")
        .filter(F.length("value") > 0)
    )


def read_samples(
    spark: SparkSession, folder: str, glob: str = "*.jsonl", merged: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Canonical objects of a JSONL folder, and the quarantined lines."""
    return canonical(read_lines(spark, folder, glob, merged), keep=LINE_COLUMNS, stripped=True)


def read_typed(
    spark: SparkSession, folder: str, schema: str, required: Sequence[str], glob: str = "*.jsonl"
) -> DataFrame:
    """JSONL rows under an explicit schema; a row lacking a required column is an error."""
    good, _ = read_samples(spark, folder, glob)
    rows = good.withColumn("_row", F.from_json("canonical", schema, {"mode": "FAILFAST"}))
    keys = F.json_object_keys("canonical")
    missing = F.array_except(F.array(*[F.lit(name) for name in required]), keys)
    checked = F.when(
        F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing columns: "), F.array_join(missing, ", ")))
    ).otherwise(F.col("_row"))
    return rows.withColumn("_row", checked).select(*LINE_COLUMNS, "_row.*")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def _whole(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files with their name and the name of their folder; a file is one value, of at most 2 GB."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .select("value", _path_part(1).alias("file_name"), _path_part(2).alias("folder"))
    )


def read_json_object(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Key and value rows of files that each hold one flat JSON object."""
    entries = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    return _whole(spark, path, glob).select(F.explode(entries).alias("key", "value"))


def read_membership(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """``(mode, opts, func)`` rows of ``{bits: {level: [name]}}`` files."""
    nested = F.from_json("value", "map<string,map<string,array<string>>>", {"mode": "FAILFAST"})
    by_mode = _whole(spark, path, glob).select(F.explode(nested).alias("mode", "_levels"))
    by_level = by_mode.select("mode", F.explode("_levels").alias("opts", "_names"))
    return by_level.select("mode", "opts", F.explode("_names").alias("func"))


def read_name_list(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Names of Python-style list files, with their position in the list."""
    quoted = F.regexp_extract_all("value", F.lit(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""), F.lit(0))
    names = F.transform(
        quoted, lambda q: F.regexp_replace(q.substr(F.lit(2), F.length(q) - 2), r"\\(.)", "$1")
    )
    return _whole(spark, path, glob).select("file_name", F.posexplode(names).alias("pos", "func"))


def _entity_files(spark: SparkSession, path: str, glob: str, named_by: str) -> DataFrame:
    """Whole files with ``name``: the file's, or that of its ``key=name`` folder."""
    if named_by == "file":
        return _whole(spark, path, glob).withColumnRenamed("file_name", "name")
    return _whole(spark, path).withColumn("name", F.regexp_replace("folder", "^[^=]*=", ""))


def read_entity_texts(
    spark: SparkSession, path: str, suffix: str, key: str = "func", text: str = "text", named_by: str = "file"
) -> DataFrame:
    """One text per entity, from files (or folders) named ``<entity><suffix>``."""
    name = F.col("name").substr(F.lit(1), F.length("name") - len(suffix))
    files = _entity_files(spark, path, f"*{suffix}", named_by).filter(F.endswith("name", F.lit(suffix)))
    return files.select(name.alias(key), F.col("value").alias(text))


def read_level_texts(
    spark: SparkSession, path: str, tail: str = ".c", text: str = "text", named_by: str = "file"
) -> DataFrame:
    """Texts named ``<entity>_<level><tail>``, as ``func, opts, text``."""
    pattern = rf"^(.*)_(O[0-3]){tail.replace('.', '[.]')}$"
    files = _entity_files(spark, path, f"*{tail}", named_by).filter(F.col("name").rlike(pattern))
    return files.select(
        F.regexp_extract("name", pattern, 1).alias("func"),
        F.regexp_extract("name", pattern, 2).alias("opts"),
        F.col("value").alias(text),
    )
