"""Evaluation of results that arrive in loads, from stored state.

A load is one run of result rows. What is stored of it is not its rows but what
they add up to: the last write of each key for the verdict rates and pass@k.
A load reads its own rows and the state it can change, nothing else: keys live
in buckets, and only buckets with a key of the load are read and written anew.
The levels' sums are kept for each bucket, so a report adds up buckets and reads
no key.

A load that is repeated, or that died before its end, counts once: the state of a
bucket is named by the loads in it, and a version becomes visible in one step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.passk import pass_at_k
from millrace.operators.latest import last_write
from millrace.operators.scoring import on_opt_levels
from millrace.sinks import runs

BUCKETS = 256


def _bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class ArrivingVerdicts:
    """Verdicts per (task_id, opts, sample), the last write of each, over loads.

    ``table`` is a folder that all executors reach. Rows have ``task_id``,
    ``opts``, ``sample``, ``written`` (what orders the writes of a key; equal
    ones are ordered by the flags) and ``flag_compile`` and ``flag_run`` (0 or
    1). A null key is a key. A task's samples share a bucket, so that n and c of
    a task come from one bucket.
    """

    KEYS = ("task_id", "opts", "sample")
    SCHEMA = "task_id long, opts string, sample long, written long, flag_compile int, flag_run int"
    TASKS = "bucket int, task_id long, opts string, n long, compiled long, c long"

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets
        self.fields = StructType.fromDDL(self.SCHEMA).fieldNames()

    def _path(self, kind: str, bucket: int | str) -> str:
        return f"{self.table}/{kind}-{bucket}"

    def load(self, rows: DataFrame, name: str) -> list[int]:
        """Add the rows of load ``name`` to the state; returns the buckets that were read and written.

        The last write does not depend on the order of the loads, and taking
        rows in twice changes nothing, so a load may be run again at any time.
        """
        keyed = last_write(rows.select(*self.fields), self.KEYS, ["written", "flag_run", "flag_compile"])
        keyed = keyed.withColumn("bucket", _bucket_of(["task_id"], self.buckets))
        incoming = f"{self.table}/incoming/{name}"
        keyed.write.mode("overwrite").partitionBy("bucket").parquet(incoming)
        arrived = self.spark.read.schema(f"{self.SCHEMA}, bucket int").parquet(incoming)
        # At most ``buckets`` numbers, from the names of folders.
        touched = sorted(row[0] for row in arrived.select("bucket").distinct().collect())
        if not touched:
            return touched
        old = self._read("keys", touched, f"{self.SCHEMA}, bucket int")
        merged = last_write(old.unionByName(arrived), [*self.KEYS, "bucket"], ["written", "flag_run", "flag_compile"])
        self._publish("keys", merged, touched, name)
        current = self._read("keys", touched, f"{self.SCHEMA}, bucket int")
        tasks = current.groupBy("bucket", "task_id", "opts").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("flag_compile").cast("long").alias("compiled"),
            F.sum("flag_run").cast("long").alias("c"),
        )
        self._publish("tasks", tasks, touched, name)
        return touched

    def _publish(self, kind: str, rows: DataFrame, touched: Sequence[int], name: str) -> None:
        """One write of all touched buckets, then one mark that names what stands for each of them."""
        runs.write_parts(rows, f"{self.table}/{kind}", "bucket", touched, name)

    def _read(self, kind: str, buckets: Sequence[int] | None, schema: str) -> DataFrame:
        return runs.read_parts(self.spark, f"{self.table}/{kind}", "bucket", schema, buckets)

    def verdicts(self) -> DataFrame:
        """The last write of every key."""
        return self._read("keys", None, f"{self.SCHEMA}, bucket int").select(*self.fields)

    def tasks(self) -> DataFrame:
        """Samples ``n``, compiled and correct samples ``c`` per task and level; reads no verdicts."""
        return self._read("tasks", None, self.TASKS).drop("bucket")

    def rates(self) -> DataFrame:
        """Evaluated rows, compile and run rate on all levels."""
        sums = self.tasks().groupBy("opts").agg(
            F.sum("n").alias("evaluated"), F.sum("compiled").alias("compiled"), F.sum("c").alias("ran")
        )
        return on_opt_levels(sums, ["evaluated", "compiled", "ran"], 0).select(
            "opts",
            F.col("evaluated").cast("long").alias("evaluated"),
            F.try_divide("compiled", "evaluated").alias("compile_rate"),
            F.try_divide("ran", "evaluated").alias("run_rate"),
        )

    def mean_pass_at_k(self, ks: Sequence[int] = (1, 10)) -> DataFrame:
        """Mean pass@k on all levels."""
        names = [f"pass_at_{k}" for k in ks]
        scored = self.tasks().select("opts", *[pass_at_k("n", "c", k).alias(name) for k, name in zip(ks, names, strict=True)])
        return on_opt_levels(scored.groupBy("opts").agg(*[F.avg(name).alias(name) for name in names]), names)
