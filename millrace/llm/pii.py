"""Personal data: fixed patterns, and contexts learned from what they find.

Valid e-mail addresses, IP addresses, card numbers and telephone numbers are the
seeds. What stands around a seed makes lexical patterns: the words beside it, a word
and the shape of the next (so that ``call Ann:`` and ``call Bob:`` are one), the first
word of its line, and a key such as ``tel:`` before it. The same
patterns around other tokens with digits, ``@``, ``(at)`` or ``[at]`` connect patterns
and instances in a graph. What is before a token also counts apart for the instances that have the
form of one kind, so that house numbers do not speak against a telephone's context.
Each round scores a pattern by the share of its instances known to be of one kind, and
an instance by the patterns it stands in (noisy or). Patterns with enough support and
confidence name the unseen identifiers in them, which then support further patterns,
until a round changes nothing. All of it is DataFrame work over (pattern, instance)
rows; no pattern or instance is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.spans import count_of, matches, no_spans, rendered
from millrace.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

EMAIL_PATTERN = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_PATTERN = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Chains of fewer than 13 digits cannot become cards, and lie inside no longer one.
CARD_PATTERN = r"[0-9](?:[\x20-]?+[0-9]){12}(?:[\x20-]?+[0-9])*+"
PHONE_PATTERN = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

SPELT_AT = r"(?i:\(at\)|\[at\])"
# A run without spaces that holds a digit or @, with the digit groups that follow it, or one with a spelt @.
TOKEN_PATTERN = rf"(?<!\S)(?:[^\s0-9@]*+[0-9@]\S*+(?:\x20[0-9()+.-]++(?!\S))*+|\S*?{SPELT_AT}\S*+)"
LEAD_MARKS = r"^[\"'(\[<{,;:.!?]*+"
END_MARKS = r"[\"')\]>},;:.!?]++$"
# A name and a colon or equals sign before a value, but not the start of a URL.
KEY = r"([A-Za-z][A-Za-z_.-]*+[:=]++)(?!/)[\"'(\[<{]*+"
CONTEXT_CHARACTERS = 80

# Scores only grow from round to round; they are stable when their sum grows by no more than this.
STABLE = 1e-3
MIN_SUPPORT = 3.0
MIN_CONFIDENCE = 0.8
# Shapes that an unseen instance of each kind must have.
SHAPES = {
    EMAIL: r"(?i)^[a-z0-9._%+-]+(?:@|\(at\)|\[at\])[a-z0-9.-]+$",
    IP: r"^[0-9]{1,3}(?:[.:-][0-9]{1,3}){3,7}$",
    CARD: r"^[0-9](?:[ .-]?[0-9]){11,18}$",
    PHONE: r"^\(?[0-9][0-9() ./-]{5,16}[0-9]$",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check; read from the right, every second is doubled."""
    digits = F.reverse(_digits(match))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda total, i: total
        + F.when(i % 2 == 1, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
            2 * F.substring(digits, i, F.lit(1)).cast("int")
            - F.when(F.substring(digits, i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """Valid spans of the fixed patterns, by kind and then start."""
    digit = text.rlike("[0-9]")
    return F.concat(
        matches(text, EMAIL_PATTERN, EMAIL, None, F.contains(text, F.lit("@"))),
        matches(text, IP_PATTERN, IP, lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"), digit & F.contains(text, F.lit("."))),
        matches(text, CARD_PATTERN, CARD, _luhn, digit),
        matches(
            text, PHONE_PATTERN, PHONE, lambda m: F.length(_digits(m)).between(9, 15), digit & F.contains(text, F.lit("+"))
        ),
    )


def _tokens(text: Column) -> Column:
    """Tokens with a digit, @ or a spelt @: value, start, and the text on both sides."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    gaps = F.split(text, TOKEN_PATTERN, -1)
    near = F.lit(CONTEXT_CHARACTERS)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        token = F.struct(
            part["match"].alias("value"),
            start.alias("start"),
            F.right(part["gap"], near).alias("left"),
            F.left(part["after"], near).alias("right"),
        )
        return F.struct(
            (start + F.length(part["match"])).alias("at"), F.concat(state["tokens"], F.array(token)).alias("tokens")
        )

    kind = "array<struct<value:string,start:bigint,left:string,right:string>>"
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("tokens"))
    # Zipped, so that the text is cut once and not for every token.
    after = F.slice(gaps, F.lit(2), F.size(gaps))
    parts = F.filter(
        F.arrays_zip(gaps.alias("gap"), found.alias("match"), after.alias("after")), lambda part: part["match"].isNotNull()
    )
    return F.aggregate(parts, empty, step, lambda state: state["tokens"])


def _shape(word: Column) -> Column:
    """Runs of small letters, capitals and digits as one sign each; other characters stay."""
    for signs, sign in ((r"[\p{L}&&[^\p{Lu}]]+", "a"), (r"\p{Lu}+", "A"), ("[0-9]+", "9")):
        word = F.regexp_replace(word, signs, sign)
    return word


def _patterns(left: Column, right: Column, at_start: Column, key: Column, kinds: Column) -> Column:
    """The patterns of a token: words alone for all, what is before it once more for each kind whose form it has."""
    word = F.regexp_extract(left, r"(\S++)\s*$", 1)
    last = F.lower(word)
    before = F.lower(F.regexp_extract(left, r"(\S++)\s++\S++\s*$", 1))
    after = F.lower(F.regexp_extract(right, r"^\s*(\S++)", 1))
    begun = at_start | F.contains(left, F.lit("\n"))
    line = F.regexp_extract(left, r"([^\n]*+)$", 1)
    first = F.lower(F.regexp_extract(line, r"^\s*(\S++)", 1))
    both = (last != "") & (before != "")
    ahead = [
        F.when(last != "", F.concat(F.lit("left "), last)),
        F.when(both, F.concat_ws(" ", F.lit("left"), before, last)),
    ]
    general = [
        F.when(both, F.concat_ws(" ", F.lit("skip"), before, _shape(word))),
        F.when(begun & (first != ""), F.concat(F.lit("line "), first)),
        F.when(key != "", F.concat(F.lit("key "), F.lower(key))),
    ]
    words = F.filter(F.array(*ahead, F.when(after != "", F.concat(F.lit("right "), after))), lambda p: p.isNotNull())
    contexts = F.filter(F.array(*ahead, *general), lambda p: p.isNotNull())
    of_kind = F.transform(kinds, lambda kind: F.transform(contexts, lambda p: F.concat(kind, F.lit("|"), p)))
    return F.concat(words, F.flatten(of_kind))


def _occurrences(found: DataFrame) -> DataFrame:
    """One row for every token: where it is, its value without key and edge marks, its kind if it is a seed, and its patterns."""
    token = found.select("doc_id", "text_hash", F.explode("tokens").alias("t")).select(
        "*",
        F.regexp_extract("t.value", rf"{LEAD_MARKS}(?:{KEY})?+", 0).alias("head"),
        F.regexp_extract("t.value", rf"{LEAD_MARKS}{KEY}", 1).alias("key"),
    )
    lead = F.length("head")
    value = F.regexp_replace(F.substr(F.col("t.value"), lead + 1), END_MARKS, "")
    token = token.select("*", lead.alias("lead"), value.alias("value")).withColumn(
        "seed", F.get(base_spans(F.col("value")), F.lit(0))["kind"]
    )
    forms = F.array(
        *[F.when((F.col("seed") == k) | F.col("value").rlike(shape), KINDS[k]) for k, shape in sorted(SHAPES.items())]
    )
    at_start = F.col("t.start") == F.length("t.left")
    return token.select(
        "doc_id",
        "text_hash",
        (F.col("t.start") + F.col("lead")).alias("start"),
        "value",
        "seed",
        _patterns(
            F.col("t.left"), F.col("t.right"), at_start, F.col("key"), F.filter(forms, lambda f: f.isNotNull())
        ).alias("patterns"),
    )


def _discovered(occurrences: DataFrame, rounds: int | None, support: float, confidence: float) -> DataFrame:
    """value and kind of the unseen instances that trusted patterns name."""
    edges = cut_lineage(occurrences.select("value", "seed", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    known = edges.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    # An instance may be scored for several kinds, so patterns count their instances apart.
    sizes = cut_lineage(
        edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances")).filter(F.col("instances") >= support), "pii-sizes"
    )
    shape = F.lit(False)
    for kind, pattern in SHAPES.items():
        shape = shape | ((F.col("kind") == kind) & F.col("value").rlike(pattern))
    new, before, done = known.limit(0), 0.0, 0
    while rounds is None or done < rounds:
        trusted = (
            edges.join(known.union(new), "value")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("support"))
            .filter(F.col("support") >= support)
            .join(sizes, "pattern")
            .withColumn("trust", F.col("support") / F.col("instances"))
            .filter(F.col("trust") >= confidence)
        )
        new = cut_lineage(
            edges.filter("seed is null")
            .join(trusted.select("pattern", "kind", "trust"), "pattern")
            .filter(shape)
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("trust"), F.lit(0.99)))))).alias("score"))
            .filter(F.col("score") >= confidence),
            "pii-instances",
        )
        done += 1
        total = new.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        if total <= before + STABLE:
            break
        before = total
    return new.groupBy("value").agg(F.max(F.struct("score", -F.col("kind"))).alias("best")).select(
        "value", (-F.col("best.col2")).alias("kind")
    )


def personal_data(
    docs: DataFrame, rounds: int | None = None, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """doc_id, base (spans of the fixed patterns) and found (all spans, by kind and start) for every row of ``docs``.

    Rounds go on until the scores are stable, or for ``rounds`` of them.
    ``support`` is the least sum of instance scores behind a pattern, and
    ``confidence`` the least share of its instances, and the least score of a new
    instance. An instance that several kinds claim gets the kind of the highest
    score, the first kind of a tie. Null and empty texts have no spans. Repeated
    rows and repeated or null ids each give their own row. An empty table gives
    an empty result. No columns besides doc_id and text are read.
    """
    text = F.coalesce("text", F.lit(""))
    searched = docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        base_spans(text).alias("base"),
        F.when(text.rlike(f"[0-9@]|{SPELT_AT}"), _tokens(text)).alias("tokens"),
    )
    found = cut_lineage(searched, "pii-spans")
    occurrences = cut_lineage(_occurrences(found), "pii-tokens")
    instances = _discovered(occurrences, rounds, support, confidence)
    added = (
        occurrences.filter("seed is null")
        .join(instances, "value")
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_set(
                F.struct(
                    F.col("kind").cast("int").alias("kind"), "start", (F.col("start") + F.length("value")).alias("stop")
                )
            ).alias("added")
        )
        .select(F.col("doc_id").alias("added_id"), F.col("text_hash").alias("added_hash"), "added")
    )
    same = F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("text_hash") == F.col("added_hash"))
    return found.join(added, same, "left").select(
        "doc_id", "base", F.sort_array(F.concat("base", F.coalesce("added", no_spans()))).alias("found")
    )


def digest(result: DataFrame) -> DataFrame:
    """Counts of the base spans, their digest, and all spans as text."""
    base = F.col("base")
    return result.select(
        "doc_id",
        *[count_of(base, i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(rendered(base, KINDS), 256).alias("base_sha256"),
        rendered(F.col("found"), KINDS).alias("spans"),
        (F.size("found") - F.size("base")).cast("long").alias("n_added"),
    )
