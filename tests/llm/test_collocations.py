import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import lowered

from millrace.llm import collocations as co


def plainly(rows, least, first):
    """The contract by plain loops."""
    counts = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 6):
                counts["und" if lang is None else lang].update(
                    " ".join(words[i : i + size]) for i in range(len(words) - size + 1)
                )
    result = []
    for lang, f in counts.items():
        n = sum(v for k, v in f.items() if " " not in k)
        candidates = {k: v for k, v in f.items() if " " in k and v >= least}
        covered = set()
        for longer, c in candidates.items():
            words = longer.split(" ")
            for size in range(2, len(words)):
                for i in range(len(words) - size + 1):
                    part = " ".join(words[i : i + size])
                    if 100 * c >= 100 * f[part]:
                        covered.add(part)
        held = []
        for phrase, a in candidates.items():
            if phrase in covered:
                continue
            words = phrase.split(" ")
            cuts = []
            for k in range(1, len(words)):
                l, r = f[" ".join(words[:k])], f[" ".join(words[k:])]
                cuts.append((1000 * a * n // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            held.append((-score, -a, phrase.encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(held)[:first], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(result)


def test_all_documents_against_plain_code(documents):
    rows = [(r["text"], r["lang"]) for r in documents.collect()]
    for least, first in ((100, 2000), (5, 50)):
        found = co.collocations(documents, least, first).collect()
        assert sorted(map(tuple, found)) == plainly(rows, least, first)
    assert len(found) > 50


def drawn(seed, count):
    draw = random.Random(seed)
    stock = ["New", "york", "city", "the", "Of", "a", "Ünion", "x\x00y", "<b>", "in one"]
    ends = [".", ",", " ! ", "\n", "\r\n", ";;", " ", "\t", ": ? "]
    for _ in range(count):
        words = [draw.choice(stock[: draw.choice((3, 10))]) for _ in range(draw.randrange(0, 60))]
        yield "".join(word + (draw.choice(ends) if draw.random() < 0.2 else " ") for word in words), draw.choice(("en", None, "und", ""))


def test_drawn_texts_many_copies_and_small_sieve(spark, monkeypatch):
    rows = [*drawn(1, 300), *[("one passage. " + "the new york city of " * 9, "en")] * 150, ("a " * 5000, "de"), ("\t \n", "xx"), (None, "zz")]
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    wanted = plainly(rows, 20, 2000)
    for bits in (16, 4):
        monkeypatch.setattr(co, "SIEVE_LEAST", bits)
        monkeypatch.setattr(co, "SIEVE_MOST", max(bits, 5))
        assert sorted(map(tuple, co.collocations(frame, 20).collect())) == wanted


def test_texts_a_few_at_a_time(spark, documents, monkeypatch):
    rows = [(r["text"], r["lang"]) for r in documents.limit(60).collect()]
    frame = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    monkeypatch.setattr(co, "TEXT_BYTES", 1000)
    assert sorted(map(tuple, co.collocations(frame, 10).collect())) == plainly(rows, 10, 2000)


def test_thresholds_beyond_a_byte(spark):
    rows = [("alpha beta", "en")] * 300 + [("gamma delta", "en")] * 260
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, co.collocations(frame, 280).collect())) == plainly(rows, 280, 2000)


def test_chunks_cover_every_place_once_and_depend_on_content_only():
    draw = random.Random(3)
    words = [str(draw.randrange(500)) for _ in range(4000)]

    def chunks(*texts):
        stream = [word for text in texts for word in text]
        bounds = np.concatenate([[0], np.cumsum([len(text) for text in texts])])
        starts, ends, own = co.chunk_bounds(co.hashes_of(pa.array(stream, pa.string())), bounds)
        assert np.concatenate([np.arange(s, s + o) for s, o in zip(starts, own)]).tolist() == list(range(len(stream)))
        for start, end, of in zip(starts, ends, own):
            last = bounds[np.searchsorted(bounds, start, "right")]
            assert end == min(last, start + of + 4) and (end == last or start + of in starts)
        return [(o, *stream[s:e]) for s, e, o in zip(starts, ends, own)]

    alone = chunks(words)
    assert 60 < len(alone) < 250
    # Only the first chunk knows what stands before a text.
    assert len(set(alone) - set(chunks(["before", "it", *words]))) <= 1
    assert set(chunks(words, [], ["x"], words)) == set(alone) | {(1, "x")}
    assert len(set(chunks([*words, *words]))) <= len(alone) + 3


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    rows = [("en", "", 0, 10**15), ("en", "a", 1, big), ("en", "b", 1, big - 7), ("en", "a b", 2, big - 11)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, size int, f long")
    found = co.scored(co.maximal(counts), counts).collect()
    assert [tuple(r) for r in found] == [("en", "a b", big - 11, big, big - 7, 10**15, 1000 * (big - 11) * 10**15 // (big * (big - 7)))]


def test_equal_scores_in_byte_order_and_the_first_cut(spark):
    rows = [(f"{a} {b}", "en") for a, b in (("é", "z"), ("z", "é"), ("Z", "y"), ("😀", "￮")) for _ in range(4)]
    rows += [("one two three", "fr")] * 4
    found = co.collocations(spark.createDataFrame(rows, "text string, lang string"), 4, 3).collect()
    assert sorted(map(tuple, found)) == plainly(rows, 4, 3)


def test_odd_and_empty(odd, nothing):
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    assert sorted(map(tuple, co.collocations(odd, 50).collect())) == plainly(rows, 50, 2000)
    assert co.collocations(nothing).count() == 0


@pytest.mark.parametrize("name", ["phrase", "n", "size", "a", "k"])
def test_clashing_names(spark, name):
    frame = spark.createDataFrame([("a b", "en")] * 5, "text string, lang string").selectExpr("*", f"'x' as {name}")
    assert [tuple(r) for r in co.collocations(frame, 5).collect()] == plainly([("a b", "en")] * 5, 5, 10)
