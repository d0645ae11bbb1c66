import math
import re
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from millrace.llm.urlfilter import FOLDS, PRIOR, RULES, host_of, judge_urls, lexical_features, path_of, with_suffix_statistics


def expected(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fitting = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fitting, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


ODD = [
    None,
    "",
    "no scheme.org/",
    "http://",
    "https://ORG",
    "https://a.ORG/",
    "https://x.example.org/es/1?a=/en/1",
    "https://example.org/en/19",
    "https://notexample.org/en/19",
    "https://u@b.com:80/de/",
    "ftp://b.com/de/x://y.org/",
    "https://b.com/frx",
    "https://b.com?x=/fr/",
    "https://ÄB.Com/fr/é#?",
    "https://b.net/" + "a1" * 40000,
]


def test_rules_against_brute_force(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url", F.lit("x").alias("host"))
    odd = spark.createDataFrame([(1000 + i, url, "x") for i, url in enumerate(ODD)], "page_id long, url string, host string")
    both = pages.union(odd).union(odd)
    urls = {row["page_id"]: row["url"] for row in both.collect()}
    rows = judge_urls(both, trees=3).collect()
    assert len(rows) == both.count()
    for row in rows:
        host, path, rule, verdict = expected(urls[row["page_id"]])
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")


def test_trees_learn_from_ruled_urls(spark):
    rows = [(i, f"https://s{i}.example.com/{'de' if i % 2 else 'fr'}/{'9' * (20 if i % 2 else 2)}") for i in range(80)]
    rows += [(100, "https://t.example.com/en/" + "9" * 20), (101, "https://t.example.com/en/99")]
    found = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), trees=5).collect()}
    assert (found[100], found[101]) == ("block", "allow")


@pytest.mark.parametrize(("urls", "verdict"), [(["https://a.net/x"], "allow"), (["https://a.com/de/", "https://a.net/"], "block")])
def test_without_labels_of_both_kinds(spark, urls, verdict):
    rows = judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    assert {row["verdict"] for row in rows} == {verdict}


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_own_verdict_is_in_no_feature(spark):
    # Every host is alone in its suffix: a rate that held its own label would say all, and nothing of URLs without one.
    rows = [(i, f"https://h{i}.com/{'de' if i % 2 else 'fr'}/{'9' * (14 if i % 2 else 6)}") for i in range(200)]
    rows += [(1000 + i, f"https://u{i}.com/en/{'9' * (14 if i % 2 else 6)}") for i in range(100)]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string"), trees=5).filter("page_id >= 1000").collect()
    assert sum(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in found) >= 95


def test_suffix_statistics_against_plain_counts(spark):
    verdicts = ["block", "allow", None]
    rows = [(f"https://x/{i % 70}", f"s{i % 4 if i % 3 else 0}", verdicts[i % 70 * 7 % 3]) for i in range(300)]
    rows += [(None, "s9", "block"), ("https://lone", "s10", None), ("https://y", None, None)]
    frame = spark.createDataFrame(rows, "url string, suffix string, ruled string").withColumn(
        "fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    )
    labelled = frame.filter(F.col("ruled").isNotNull()).collect()
    for row in with_suffix_statistics(frame, "suffix").collect():
        labels = [
            r["ruled"]
            for r in labelled
            if r["suffix"] == row["suffix"] and row["suffix"] and not (row["ruled"] and r["fold"] == row["fold"])
        ]
        scale = FOLDS / (FOLDS - 1) if row["ruled"] else 1
        assert row["f_suffix_rate"] == pytest.approx((labels.count("block") + PRIOR / 2) / (len(labels) + PRIOR))
        assert row["f_suffix_count"] == pytest.approx(math.log1p(len(labels) * scale))
    assert with_suffix_statistics(frame, "suffix").count() == len(rows)


def test_features_against_plain_counts(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    url = F.col("url")
    columns = lexical_features(url, host_of(url), path_of(url))
    for row in frame.select("url", *[c.alias(n) for n, c in columns.items()]).collect():
        text = row["url"] or ""
        host, path = expected(row["url"])[:2]
        shares = [n / len(text) for n in Counter(text).values()]
        query = re.search(r"\?([^#]*)", text)
        assert row["f_entropy"] == pytest.approx(-sum(s * math.log2(s) for s in shares))
        assert row["f_digit_ratio"] == pytest.approx(len(re.findall("[0-9]", text)) / max(1, len(text)))
        assert (row["f_length"], row["f_depth"], row["f_host_length"]) == (len(text), path.count("/"), len(host))
        assert row["f_parameters"] == (1 + query[1].count("&") if query and query[1] else 0)
