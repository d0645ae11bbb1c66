import hashlib
import math
import zlib
from collections import Counter

import pytest

from millrace.llm import hashtree
from millrace.llm.hashtree import Tree, even_tree

SCHEMA = "doc_id long, text string"


def plainly(key, tree):
    node = ""
    for level in tree.children():
        arrivals = []
        for name, weight, shard in level[node]:
            draw = (int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            arrivals.append((-math.log(draw) / weight, name, shard))
        _, node, shard = min(arrivals)
    return node, shard


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text").cache()


def shards(docs, tree):
    return {r["doc_id"]: r["shard"] for r in docs.select("doc_id", hashtree.shard_of(docs.doc_id.cast("string"), tree)["shard"].alias("shard")).collect()}


WEIGHTED = Tree((("a", "0", 0, 1.0), ("a", "0", 1, 3.0), ("a", "1", 2, 2.0), ("b", "0", 3, 4.0), ("b", "1", 4, 0.0), ("b", "1", 5, 2.0)))


def test_descent_against_plain_code(documents):
    for tree in (WEIGHTED, even_tree(40)):
        found = hashtree.assigned(documents, tree).collect()
        for row in found:
            node, shard = plainly(row["doc_id"], tree)
            assert (f"{row['region']}/{row['rack']}/{row['shard']}", row["shard"]) == (node, shard)
        texts = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
        assert all(row["size"] == len(texts[row["doc_id"]]) + 16 for row in found)
        assert all(row["text_crc32"] == zlib.crc32(texts[row["doc_id"]]) for row in found)


def test_slots_have_no_gaps_and_follow_the_ids(documents):
    held = {}
    for row in hashtree.assigned(documents, even_tree(40)).collect():
        held.setdefault(row["shard"], []).append((row["slot"], row["doc_id"]))
    for rows in held.values():
        assert [slot for slot, _ in sorted(rows)] == list(range(len(rows)))
        assert [i for _, i in sorted(rows)] == sorted(i for _, i in rows)


def test_rows_follow_the_weights(many):
    counts = Counter(shards(many, WEIGHTED).values())
    assert counts[4] == 0
    for shard, weight in ((0, 1), (1, 3), (2, 2), (3, 4), (5, 2)):
        assert counts[shard] == pytest.approx(20_000 * weight / 12, rel=0.06)


def test_one_more_shard_takes_rows_only_into_itself(many):
    for built, count in ((40, 40), (40, 43), (7, 7)):
        before = shards(many, even_tree(count, built=built))
        after = shards(many, even_tree(count + 1, built=built))
        moved = {i for i in before if before[i] != after[i]}
        assert {after[i] for i in moved} == {count}
        assert len(moved) == pytest.approx(20_000 / (count + 1), rel=0.15)


def test_only_the_changed_subtrees_move(many):
    heavier = Tree(tuple((*leaf[:3], 6.0 if leaf[2] == 1 else leaf[3]) for leaf in WEIGHTED.leaves))
    before, after = shards(many, WEIGHTED), shards(many, heavier)
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    # Into region a from b, into rack a/0 from a/1, into shard 1 from 0; never between shards of b, or out of a.
    assert moved and all(to in (0, 1, 2) for _, to in moved)
    assert (1, 0) not in moved and (1, 2) not in moved and (0, 2) not in moved and (2, 1) in moved
    back = {(b, a) for a, b in moved}
    assert {(after[i], before[i]) for i in before if before[i] != after[i]} == back
    report = {(r["from_shard"], r["to_shard"]): r["n"] for r in hashtree.moves(many, WEIGHTED, heavier).collect()}
    assert report == Counter((before[i], after[i]) for i in before if before[i] != after[i])


def test_odd_rows(odd, nothing):
    rows = hashtree.assigned(odd, even_tree(3), even_tree(4, built=3)).collect()
    assert len(rows) == odd.count() and all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {16}
    for shard in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert hashtree.assigned(nothing, even_tree(3)).count() == 0


def test_many_equal_rows_keep_gapless_slots(spark):
    frame = spark.range(5000).selectExpr("cast(if(id % 3 = 0, null, 7) as long) as doc_id", "'same' as text")
    rows = hashtree.assigned(frame, even_tree(40)).collect()
    held = {}
    for row in rows:
        held.setdefault(row["shard"], []).append(row["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in held.values()) and len(rows) == 5000


def test_trees_that_make_no_sense():
    for leaves in ([("a", "0", 1, 1.0), ("b", "0", 1, 1.0)], [("a", "0", 1, -1.0)], [("a", "0", 1, 0.0)], []):
        with pytest.raises(ValueError):
            Tree(tuple(leaves))


def test_written_shards(spark, documents, tmp_path):
    hashtree.write_shards(documents, even_tree(4), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    wanted = {r["doc_id"]: plainly(r["doc_id"], even_tree(4))[1] for r in documents.collect()}
    assert {r["doc_id"]: r["_shard"] for r in back.collect()} == wanted and back.count() == documents.count()
