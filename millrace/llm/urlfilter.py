"""URL verdicts: allow and block rules, and boosted trees for the rest.

A rule names a host and a path prefix; it fits the host and its subdomains, and
the longest fitting rule decides. URLs that a rule decides are the labels from
which gradient-boosted trees learn on lexical features; the trees judge the URLs
without a rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut_lineage

TREES = 20
DEPTH = 4
# Labels that a suffix without any counts for, half of them blocked.
PRIOR = 10.0
# Suffix statistics of a labelled URL come from the labelled URLs of the other folds.
FOLDS = 5


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*+", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*+([^?#]*+)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Place in ``rules`` of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("int")
    for at, rule in sorted(enumerate(rules), key=lambda entry: len(entry[1].name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(at)).otherwise(found)
    return found


def _entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty text."""
    size = F.length(text).cast("double")

    def add(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(text, char, F.lit("")))) / size
        return total - share * F.log2(share)

    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.when(size > 0, F.aggregate(letters, F.lit(0.0), add)).otherwise(0.0)


def _occurrences(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("double")


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.length(text).cast("double")
    query = F.regexp_extract(text, r"\?([^#]*+)", 1)
    digits = (F.length(text) - F.length(F.translate(text, "0123456789", ""))).cast("double")
    return {
        "f_length": size,
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": _occurrences(path, "/"),
        "f_labels": _occurrences(host, ".") + (host != "").cast("double"),
        "f_digit_ratio": F.when(size > 0, digits / size).otherwise(0.0),
        "f_path_digits": (F.length(path) - F.length(F.translate(path, "0123456789", ""))).cast("double"),
        "f_entropy": _entropy(text),
        "f_parameters": F.when(query != "", 1.0 + _occurrences(query, "&")).otherwise(0.0),
        "f_fragment": F.contains(text, F.lit("#")).cast("double"),
        "f_secure": text.startswith("https://").cast("double"),
        "f_hyphens": _occurrences(host, "-"),
    }


def with_suffix_statistics(described: DataFrame, key: str) -> DataFrame:
    """``described`` (``key``, url, ruled) with f_<key>_rate and f_<key>_count of its value of ``key``.

    The share of blocked URLs and the number of labelled ones, all of them for a
    URL without label. A labelled URL counts those of the other folds only, so
    that its own verdict is in none of its features; folds go by the URL, so a
    repeated one is in one fold. Its number is scaled to all folds.
    """
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")
    blocked = (F.col("ruled") == "block").cast("double")
    sums = [
        F.array(*[F.sum(F.when(fold == i, value).otherwise(0.0)) for i in range(FOLDS)]).alias(name)
        for name, value in (("_bad", blocked), ("_all", F.lit(1.0)))
    ]
    statistics = described.filter("ruled is not null").groupBy(key).agg(*sums)

    def counted(name: str) -> Column:
        total = F.aggregate(F.col(name), F.lit(0.0), lambda sum, part: sum + part)
        own = F.when(F.col("ruled").isNotNull(), F.get(F.col(name), fold)).otherwise(0.0)
        return F.coalesce(total - own, F.lit(0.0))

    scale = F.when(F.col("ruled").isNotNull(), FOLDS / (FOLDS - 1)).otherwise(1.0)
    return described.join(statistics, key, "left").select(
        *described.columns,
        ((counted("_bad") + PRIOR / 2) / (counted("_all") + PRIOR)).alias(f"f_{key}_rate"),
        F.log1p(counted("_all") * scale).alias(f"f_{key}_count"),
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of blocking, by the trees) for every row of ``pages`` (page_id, url).

    A null url and one without ``://`` have an empty host and path and no rule.
    Without labelled URLs everything without a rule is allowed; with labels of
    one verdict it gets that verdict; score is then null. A score of a half
    blocks. Repeated rows and ids each give a row; an empty table an empty
    result. Suffix statistics cover all labelled rows, for a labelled row those of
    the other folds. No other columns are read.
    """
    names = F.array(*[F.lit(rule.name) for rule in rules])
    verdicts = F.array(*[F.lit(rule.verdict) for rule in rules])
    parts = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = parts.withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    described = parts.select(
        "page_id",
        "url",
        "host",
        "path",
        F.get(names, F.col("at")).alias("rule"),
        F.get(verdicts, F.col("at")).alias("ruled"),
        # The last two labels, and the last one.
        F.regexp_extract("host", r"([^.]*+\.[^.]*+)$|^([^.]*+)$", 0).alias("suffix"),
        F.substring_index("host", ".", -1).alias("top"),
        *[column.alias(name) for name, column in features.items()],
    )
    described = cut_lineage(described, "urls")
    blocked = (F.col("ruled") == "block").cast("double")
    totals = described.filter("ruled is not null").agg(F.count(F.lit(1)), F.coalesce(F.sum(blocked), F.lit(0.0))).first()
    for key in ("suffix", "top"):
        described = with_suffix_statistics(described, key)
    if totals[1] in (0, totals[0]):
        only = "block" if totals[1] else "allow"
        judged = described.withColumn("score", F.lit(None).cast("double")).withColumn("judged", F.lit(only))
    else:
        columns = [name for name in described.columns if name.startswith("f_")]
        described = cut_lineage(described, "url-features")
        vectors = VectorAssembler(inputCols=columns, outputCol="features").transform(described)
        labelled = vectors.filter("ruled is not null").select("features", blocked.alias("label"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=5).fit(labelled)
        judged = (
            model.transform(vectors)
            .withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
            .withColumn("judged", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
        )
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "score")
