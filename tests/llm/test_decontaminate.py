import hashlib
import re

from conftest import SMALL, lowered, prose

from millrace.llm.decontaminate import benchmark_hits, without_contaminated


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def expected(texts, items, size=10):
    windows = {}
    for item, text in items:
        words = item_words(text)
        length = min(size, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + length]), set()).add(item)
    result = {}
    for doc, text in texts.items():
        words, hit, found = item_words(text), set(), set()
        for length in {len(w) for w in windows}:
            for i in range(len(words) - length + 1):
                if (items_of := windows.get(tuple(words[i : i + length]))) is not None:
                    found |= items_of
                    hit.update(range(i, i + length))
        names = sorted(str(i) for i in found if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        result[doc] = (len(words), len(hit), len(names), digest, bool(hit))
    return result


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def result(frame):
    return {row[0]: tuple(row[1:]) for row in frame.select(*COLUMNS).collect()}


def test_whole_table_against_brute_force(spark, documents, texts):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    wanted = expected(texts, [tuple(row) for row in benchmark.select("item_id", "text").collect()])
    assert any(row[-1] for row in wanted.values())
    assert result(benchmark_hits(documents, benchmark)) == wanted
    assert result(benchmark_hits(documents, benchmark, block=2000)) == wanted
    clean = {doc for doc, row in wanted.items() if not row[-1]}
    assert {row["doc_id"] for row in without_contaminated(documents, benchmark).collect()} == clean


def test_short_repeated_and_odd_items(spark, odd):
    passage = prose(3, 60)
    items = [(1, " ".join(passage.split()[5:9])), (2, ""), (3, None), (4, "the the the"), (4, passage), (None, passage), (5, "!!! ???"), (6, "1234567890")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    ids = {0: passage, 1: None, 2: "", 3: passage.upper(), 4: "x" + passage, 5: "the the the the", 6: "a 1234567890-b"}
    frame = spark.createDataFrame(list(ids.items()), "doc_id long, text string")
    assert result(benchmark_hits(frame, benchmark)) == expected(ids, items)
    assert benchmark_hits(odd, benchmark).count() == odd.count()
    assert without_contaminated(odd, benchmark).columns == odd.columns


def test_empty(spark, documents, nothing):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert benchmark_hits(nothing, benchmark).count() == 0
    assert not benchmark_hits(documents, benchmark.limit(0)).filter("contaminated or n_items > 0").count()
    assert without_contaminated(documents, benchmark.limit(0)).count() == documents.count()
