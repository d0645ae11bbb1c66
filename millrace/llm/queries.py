"""One query per operator over the whole driver tables, with SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalog.bindings import load
import corpus_pipeline
from millrace.llm import (
    bestfit,
    collocations,
    decontaminate,
    fim,
    hashtree,
    langid,
    lm,
    near_dedup,
    oracles,
    pii,
    quality,
    secrets,
    transcripts,
    urlfilter,
)

SHARDS = 40

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame], oracle: str | None = None):
    QUERIES[function.__name__] = function
    if oracle is not None:
        ORACLES[function.__name__] = oracle.strip()
    return function


@query
def op1_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(load(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op3_secret_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query
def op5_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(load(spark, sf_dir, "pages").select("page_id", "url"))


@partial(query, oracle=oracles.NEAR_DEDUP)
def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


@partial(query, oracle=oracles.DECONTAMINATION)
def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(
        load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "benchmark")
    )
    return hits.drop("items")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.best_fit(bestfit.token_counts(load(spark, sf_dir, "documents")))


@query
def op9_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(load(spark, sf_dir, "documents").select("doc_id", "text"))


def marked_turns(turns: DataFrame) -> DataFrame:
    """``turns`` as a transcript has them: three in four open with a speaker marker in one of its spellings."""
    draw = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(12))
    spelt = {
        "user": ("User: ", "### Human:\n", "Q: ", "**You**: ", "> user: ", "[Human]: "),
        "assistant": ("Assistant: ", "### Assistant:\n", "A: ", "**AI**: ", "> bot: ", "[Model]: "),
        "system": ("System: ", "### System:\n", "Context: ", "**Instructions**: ", "> system: ", "[System]: "),
    }
    marker = F.lit("")
    for role, spellings in spelt.items():
        chosen = F.get(F.array(*[F.lit(s) for s in spellings]), F.pmod(draw, F.lit(6)).cast("int"))
        marker = F.when(F.col("role") == role, chosen).otherwise(marker)
    shown = F.when(draw < 9, marker).otherwise("")
    return turns.withColumn("text", F.concat(shown, F.coalesce("text", F.lit(""))))


@query
def op10_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the conversations, written as transcripts; the chain is counted on four fifths of them."""
    turns = marked_turns(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return transcripts.parsed(turns)


@partial(query, oracle=oracles.HASH_TREE)
def op11_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").select("doc_id", "text")
    return hashtree.assigned(documents, hashtree.even_tree(SHARDS), hashtree.even_tree(SHARDS + 1, built=SHARDS))


@partial(query, oracle=oracles.FILL_IN_MIDDLE)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(load(spark, sf_dir, "documents").select("doc_id", "text")))


@partial(query, oracle=oracles.COLLOCATIONS)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents").select("text", "lang"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
