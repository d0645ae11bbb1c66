"""Appends that can be run again: a run's rows count once, whole, or not at all.

The rows of a run go to a folder of their own attempt; when all are written an
empty file names the attempt as the run's. Readers follow those files, so the
rows of a job that died before are not seen, and of a run that was repeated only
the last attempt is.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

DATA, PUBLISHED = "data", "published"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def write_run(rows: DataFrame, table: str, run: str) -> None:
    """Write ``rows`` as what ``run`` adds to ``table``, in place of what an earlier attempt of it added."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError("a run is named by letters, digits, and . _ -")
    attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{table}/{DATA}/{run}/{attempt}")
    # Made at once or not at all, and never changed.
    mark, files = _folder(rows.sparkSession, f"{table}/{PUBLISHED}/{run}/{attempt}")
    files.create(mark, False).close()


def published(spark: SparkSession, table: str) -> dict[str, str]:
    """The attempt that stands for each run of ``table``: the last of those published."""
    folder, files = _folder(spark, f"{table}/{PUBLISHED}")
    found: dict[str, str] = {}
    if not files.exists(folder):
        return found
    marks = files.listFiles(folder, True)
    while marks.hasNext():
        mark = marks.next().getPath()
        run, attempt = mark.getParent().getName(), mark.getName()
        found[run] = max(attempt, found.get(run, ""))
    return found


def read_runs(spark: SparkSession, table: str, schema: StructType | str) -> DataFrame:
    """The rows of all runs of ``table``; none where nothing was published."""
    paths = [f"{table}/{DATA}/{run}/{attempt}" for run, attempt in sorted(published(spark, table).items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def append_generated_run(
    inputs: DataFrame, generated: DataFrame, keys: list[str], table: str, run: str
) -> DataFrame:
    """Add the inputs that have a generated text, as ``run``; returns the inputs that have none."""
    write_run(inputs.join(generated, keys), table, run)
    return inputs.join(generated, keys, "left_anti")
