"""Raw JSON lines to stored packed rows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.jsontext import canonical_lines
from millrace.functions.tokenizers import ByteTokenizer
from millrace.operators import packing, prompts, sharding
from millrace.operators.ordered import with_range_bucket
from millrace.operators.tokens import LABEL_BUDGET, MAX_LENGTH, tokenise_packed, within_budget
from millrace.session import cut_lineage, remove_folder
from millrace.sinks.tables import write_packed
from millrace.sources.jsonl import LINE_COLUMNS, read_lines

SAMPLE_SCHEMA = ", ".join(f"{name} string" for name in prompts.SOURCE_COLUMNS)
LINE_ORDER = ["folder", "file_name", "path", "line_no"]


def shard_samples(samples: DataFrame, num_parts: int, bins: int) -> DataFrame:
    """Samples with ``part``, ``split`` and their place ``row_id`` in the part.

    The files of each folder, in name order, are cut into runs, and the rows of
    a part, in file and line order, into percent slices. The lines of one input
    split make a bucket, so a part of any size is numbered split by split.
    """
    files = samples.select("folder", "path").distinct().withColumn("directory", F.regexp_replace("path", "/[^/]*$", ""))
    listed = with_range_bucket(files, "directory", "path")
    parts = sharding.assign_parts(listed, num_parts, folder="directory", order="path", bucket=F.col("range_bucket"))
    merged = sharding.merge_parts(parts).select("path", "part")
    rows = samples.drop("part").join(merged, "path")
    input_split = F.struct("folder", "file_name", "path", "line_no.block_start")
    return sharding.assign_slices(rows, bins, order=LINE_ORDER, bucket=input_split, position="row_id")


def tokenised_samples(samples: DataFrame, template: str, tokenizer, max_length: int, budget: int) -> DataFrame:
    """Token rows within the budget, and unusable samples with their text in ``rejected``.

    ``input_ids`` are packed, ``hidden`` is how many leading labels are masked. A row over the budget or of
    one token has no ids, and the reason in ``dropped``.
    """
    parsed = samples.withColumn("sample", F.from_json("canonical", SAMPLE_SCHEMA))
    prompted = prompts.with_prompt(parsed.select("part", "split", "row_id", "canonical", "sample.*"), template)
    unusable = F.col("prompt").isNull() | F.col("sourcecode").isNull()
    flagged = prompted.select(
        "part", "split", "row_id", "prompt", "sourcecode", F.when(unusable, F.col("canonical")).alias("rejected")
    )
    counted = flagged.withColumn("source_length", F.lit(1) + tokenizer.count("prompt"))
    over = F.col("rejected").isNull() & ~within_budget("prompt", "source_length", max_length, budget)
    marked = counted.withColumn("over", over).withColumn("sourcecode", F.when(~F.col("over"), F.col("sourcecode")))
    tokens = tokenise_packed(marked, tokenizer=tokenizer, max_length=max_length)
    dropped = F.when(F.col("over"), "label budget").when(F.col("seq_length") <= 1, "length")
    hidden = F.when(F.length("prompt") == 0, 0).otherwise(F.col("source_length"))
    return tokens.withColumn("dropped", dropped).select(
        "part",
        "split",
        "row_id",
        F.when(F.col("dropped").isNull(), F.col("input_ids")).alias("input_ids"),
        hidden.alias("hidden"),
        "seq_length",
        "rejected",
        "dropped",
    )


def prepare_corpus(
    spark: SparkSession,
    source: str,
    target: str,
    num_parts: int = 80,
    bins: int = 4,
    max_length: int = MAX_LENGTH,
    budget: int = LABEL_BUDGET,
    template: str = "plain",
    tokenizer=None,
    keep_residual: bool = True,
    seed: int = 0,
    glob: str = "*.jsonl",
) -> DataFrame:
    """Read, canonicalise, shard, prompt, tokenise, pack and store; returns the stored statistics.

    Packed rows go to ``packed`` below ``target``, what could not be used to
    ``rejected_lines`` and ``rejected_samples``, and how many rows the label
    budget and the length test removed to ``dropped_rows``. The canonical lines,
    the tokens and the packing plan are stored once each, as several steps read
    them, in a folder below ``target`` that is deleted at the end.
    """
    work = os.path.join(target, f"_work-{uuid.uuid4().hex}")
    lines = cut_lineage(canonical_lines(read_lines(spark, source, glob), keep=LINE_COLUMNS, stripped=True), "canonical", work)
    bad = lines.filter("rejected is not null").select("path", "folder", "file_name", "rejected")
    bad.write.mode("overwrite").json(os.path.join(target, "rejected_lines"))
    samples = shard_samples(lines.filter("canonical is not null").drop("rejected"), num_parts, bins)
    tokenizer = tokenizer or ByteTokenizer()
    stored = cut_lineage(tokenised_samples(samples, template, tokenizer, max_length, budget), "tokens", work)
    unusable = stored.filter("rejected is not null").select("part", "split", "row_id", "rejected")
    unusable.write.mode("overwrite").json(os.path.join(target, "rejected_samples"))
    dropped = stored.filter("dropped is not null").groupBy("part", "split", "dropped").count()
    dropped.write.mode("overwrite").json(os.path.join(target, "dropped_rows"))
    tokens = stored.filter("rejected is null and dropped is null").drop("rejected", "dropped")
    plan = cut_lineage(packing.plan_packing(tokens.drop("input_ids", "hidden"), max_length), "packing-plan", work)
    packed = packing.pack(tokens, max_length, keep_residual=keep_residual, seed=seed, hidden="hidden", plan=plan)
    write_packed(packed, os.path.join(target, "packed"))
    statistics = os.path.join(target, "statistics")
    packing.packing_stats(plan, keep_residual=keep_residual).write.mode("overwrite").parquet(statistics)
    remove_folder(spark, work)
    return spark.read.parquet(statistics)
