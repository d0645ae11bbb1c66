"""Secret scan over a trigram inverted index.

Each rule's pattern yields a Boolean query of trigrams that any match contains.
The index holds, for every trigram the rules ask for, the documents with it;
postings are intersected per document, and only documents that satisfy a rule's
query are searched with its pattern. Rules without a mandatory trigram search
every document. The index is on lower-cased text, so it serves both cases.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import by_start, count_of, matches, no_spans, rendered
from millrace.llm.trigrams import trigram_query

_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None


RULES = (
    Rule("assign", _ASSIGN, lambda match: F.length(F.regexp_extract(match, _ASSIGN, 1)) >= 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("code_host_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("api_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment_key", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed_token", "eyJ[A-Za-z0-9_-]{8,}+\\.eyJ[A-Za-z0-9_-]{8,}+\\.[A-Za-z0-9_-]{8,}+"),
    Rule("url_password", "[a-z]{2,12}://[A-Za-z0-9._%-]{1,64}:[^\\s:/@]{3,64}@[A-Za-z0-9.-]{1,255}"),
)
BASE = 3


def _row_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash and trigram for the trigrams that ``rules`` ask for, once per document and trigram."""
    asked = sorted({t for rule in rules for group in trigram_query(rule.pattern) for choice in group for t in choice})
    lowered = _row_key(docs).select("doc_id", "text_hash", F.lower("text").alias("lowered"))
    there = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in asked]))
    return lowered.select("doc_id", "text_hash", F.explode(there.cast("array<string>")).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash and the names of the rules whose queries the document's trigrams satisfy."""
    spark = index.sparkSession
    terms, groups = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        groups += [(rule.name, len(query))] * bool(query)
        for number, group in enumerate(query):
            for choice, wanted in enumerate(sorted(map(sorted, group))):
                terms += [(t, rule.name, number, choice, len(wanted)) for t in wanted]
    # Both tables come from the rules alone, a few hundred rows.
    term = F.broadcast(spark.createDataFrame(terms, "trigram string, rule string, part int, choice int, wanted int"))
    group = F.broadcast(spark.createDataFrame(groups, "rule string, parts int"))
    return (
        index.join(term, "trigram")
        .groupBy("doc_id", "text_hash", "rule", "part", "choice", "wanted")
        .agg(F.count_distinct("trigram").alias("there"))
        .filter("there = wanted")
        .groupBy("doc_id", "text_hash", "rule")
        .agg(F.count_distinct("part").alias("met"))
        .join(group, "rule")
        .filter("met = parts")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("rule").alias("rules"))
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash and spans (by start, then rule) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no spans. Rows are matched to their postings by id
    and text, so repeated rows and repeated or null ids each give their own row.
    An empty table gives an empty result. Other columns are not read.
    """
    keyed = _row_key(docs)
    indexed = [bool(trigram_query(rule.pattern)) for rule in rules]
    chosen = candidates(postings(docs, rules), rules).select(
        F.col("doc_id").alias("rule_id"), F.col("text_hash").alias("rule_hash"), "rules"
    )
    same = F.col("doc_id").eqNullSafe(F.col("rule_id")) & (F.col("text_hash") == F.col("rule_hash"))
    verified = (
        keyed.join(chosen, same)
        .select(
            "doc_id",
            "text_hash",
            F.concat(
                no_spans(),
                *[
                    matches(F.col("text"), rule.pattern, kind, rule.valid, F.array_contains("rules", rule.name))
                    for kind, rule in enumerate(rules)
                    if indexed[kind]
                ],
            ).alias("found"),
        )
        .filter(F.size("found") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
        .select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "found")
    )
    scanned = keyed.select(
        "doc_id",
        "text_hash",
        F.concat(
            no_spans(),
            *[
                matches(F.col("text"), rule.pattern, kind, rule.valid, F.col("text").rlike(rule.pattern))
                for kind, rule in enumerate(rules)
                if not indexed[kind]
            ],
        ).alias("scanned"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    return scanned.join(verified, same, "left").select(
        "doc_id", "text_hash", by_start(F.concat("scanned", F.coalesce("found", no_spans()))).alias("spans")
    )


def digest(result: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    names = [rule.name for rule in rules]
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    return result.select(
        "doc_id",
        *[count_of(F.col("spans"), i).alias(f"n_{name}") for i, name in enumerate(names[:BASE])],
        F.sha2(rendered(base, names), 256).alias("base_sha256"),
        rendered(F.col("spans"), names).alias("spans"),
    )


def merged_spans(spans: Column) -> Column:
    """``spans`` by start, those that touch or overlap joined into one."""

    def step(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = last.isNotNull() & (span["start"] <= last["stop"])
        joined = F.struct(
            last["kind"].alias("kind"), last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop")
        )
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(spans, no_spans(), step)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; all rows and columns stay, ``n_chars`` follows the text if it is there."""
    found = (
        find_secrets(docs.select("doc_id", "text"), rules)
        .filter(F.size("spans") > 0)
        .dropDuplicates(["doc_id", "text_hash"])
    )
    name = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))
    spans, found_id, found_hash = f"{name}spans", f"{name}id", f"{name}hash"
    found = found.select(
        F.col("doc_id").alias(found_id), F.col("text_hash").alias(found_hash), merged_spans(F.col("spans")).alias(spans)
    )
    same = F.col("doc_id").eqNullSafe(F.col(found_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(found_hash))
    joined = docs.join(found, same, "left")
    text = F.col("text")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    kept = F.zip_with(starts, stops, lambda a, b: F.substring(text, a.cast("int") + 1, (b - a).cast("int")))
    changed = F.when(F.col(spans).isNotNull(), F.array_join(kept, mark)).otherwise(text)
    done = joined.select(*[changed.alias(c) if c == "text" else F.col(c) for c in docs.columns], F.col(spans))
    if "n_chars" not in docs.columns:
        return done.select(*docs.columns)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    n_chars = F.when(F.col(spans).isNotNull(), size).otherwise(F.col("n_chars")).alias("n_chars")
    return done.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])
