from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from conftest import lowered, prose, words_of  # noqa: F401

from millrace.llm.components import component_labels
from millrace.llm.near_dedup import least_agreements, near_duplicates, without_copies


def shingles(text):
    words = words_of(lowered(text))
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def expected(texts, threshold=85):
    sets = {doc: shingles(text) for doc, text in texts.items()}
    holders = {}
    for doc, found in sets.items():
        for shingle in found:
            holders.setdefault(shingle, []).append(doc)
    common = Counter(pair for docs in holders.values() for pair in combinations(sorted(docs), 2))
    parent = {doc: doc for doc in texts}

    def root(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    for (a, b), number in common.items():
        if 100 * number >= threshold * (len(sets[a]) + len(sets[b]) - number):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {doc: (len(sets[doc]), root(doc), root(doc) == doc) for doc in texts}


def result(frame):
    return {row[0]: tuple(row[1:]) for row in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def test_whole_table_against_brute_force(documents, texts):
    assert result(near_duplicates(documents)) == expected(texts)


def test_variants_around_a_text_and_chains(spark):
    base = prose(1, 150).split()
    texts, draw = {}, np.random.default_rng(3)
    for doc in range(120):
        changed = list(base)
        for at in draw.choice(150, int(draw.integers(0, 7)), replace=False):
            changed[at] = f"new{doc}x{at}"
        texts[doc] = " ".join(changed)
    chain = list(prose(2, 200).split())
    for doc in range(200, 220):
        chain[(doc - 200) * 9] = f"link{doc}"
        texts[doc] = " ".join(chain)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    assert result(near_duplicates(frame)) == expected(texts)


def test_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for row in rows:
        by_id.setdefault(row["doc_id"], []).append((row["n_shingles"], row["component_id"], row["kept"]))
    assert by_id[1] == [(0, 1, True)] and by_id[2] == [(0, 2, True)] and by_id[5] == [(0, 5, True)]
    assert by_id[3] == [by_id[3][0]] * 2 and by_id[3][0][1:] == (3, True)
    assert by_id[6][0][1:] == (6, True) and by_id[7][0][1:] == (6, False)
    assert [row[1:] for row in by_id[None]] == [(None, True)] * 2


def test_only_one_row_of_an_id_and_no_copy_stays(odd):
    kept = without_copies(odd)
    assert kept.columns == odd.columns
    ids = [row["doc_id"] for row in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 5, 6, 8] and ids.count(None) == 2


def test_stage_against_brute_force_at_the_general_threshold(spark, documents, texts):
    base, own = prose(5, 200).split(), dict(texts)
    for doc, changes in ((900_001, 0), (900_002, 3), (900_003, 4), (900_004, 6)):
        changed = list(base)
        for at in range(changes):
            changed[20 + 30 * at] = f"new{doc}x{at}"
        own[doc] = " ".join(changed)
    wanted = {doc for doc, row in expected(own, 80).items() if row[2]}
    assert wanted != {doc for doc, row in expected(own, 85).items() if row[2]}
    frame = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    assert {row["doc_id"] for row in corpus_pipeline.near_duplicates(spark, frame, "").collect()} == wanted


def test_empty(nothing):
    assert near_duplicates(nothing).count() == 0 and without_copies(nothing).count() == 0


@pytest.mark.parametrize("length", [2, 17, 40])
def test_components_of_paths_and_stars(spark, length):
    links = [(i, i + 1) for i in range(length)] + [(1000, 1001 + i) for i in range(length)]
    found = dict(component_labels(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(length + 1)} | {i: 1000 for i in range(1000, 1001 + length)}


def test_posterior_bound_is_the_tail_of_a_beta():
    draws = np.random.default_rng(1).beta(61, 66, 400_000)  # 60 of 125 agree, uniform prior
    assert least_agreements(125, 0.5, float((draws >= 0.5).mean()) * 0.9) <= 60
    assert least_agreements(125, 0.5, float((draws >= 0.5).mean()) * 1.1) > 60
