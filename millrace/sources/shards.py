"""Reader for stored packed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# Run mode to stored split name.
MODES = {"train": "train", "dev": "validation", "test": "test"}


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match, listed without reading them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [] if found is None else [str(status.getPath()) for status in found]


def read_packed(spark: SparkSession, paths: str | Sequence[str], mode: str = "train") -> DataFrame | None:
    """Packed rows of one or many shards for a mode; ``None`` if no shard has any.

    Shards may be partitioned by ``dataset``; a shard that is belongs to a mode
    only where it has that partition, and one that is not belongs to every mode.
    All shards of a kind are one scan.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}; got {mode!r}")
    plain, split = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        datasets = _folders(spark, f"{path}/dataset=*")
        if datasets:
            split += [folder for folder in datasets if folder.endswith(f"/dataset={MODES[mode]}")]
        else:
            plain.append(path)
    found = [spark.read.parquet(*group) for group in (plain, split) if group]
    if not found:
        return None
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
