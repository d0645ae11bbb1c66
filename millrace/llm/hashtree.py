"""Shards by a hierarchical weighted hash tree: regions, racks, shards.

A row descends the tree. At each node every child draws an arrival time from the
row's id and the child's name, exponential with the child's weight, and the first
to arrive is taken; so children receive rows in proportion to their weights. A
child's draw knows nothing of its siblings: when the weight of a subtree changes,
rows only move between it and the rest, and all others stay where they are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import with_positions, with_range_bucket
from millrace.session import cut_lineage

RACK_SHARDS, REGION_RACKS = 5, 2
BITS = 52
ROW_BYTES = 16
FILE_ROWS = 100_000


@dataclass(frozen=True)
class Tree:
    """``leaves``: region, rack, shard and weight of each shard; a weight of 0 takes no rows."""

    leaves: tuple[tuple[str, str, int, float], ...]

    def __post_init__(self):
        if len({leaf[2] for leaf in self.leaves}) < len(self.leaves):
            raise ValueError("a shard stands in the tree twice")
        if any(not 0 <= leaf[3] < math.inf for leaf in self.leaves) or not any(leaf[3] for leaf in self.leaves):
            raise ValueError("weights must not be negative, and one must be above 0")

    def children(self) -> list[dict[str, list[tuple[str, float, int]]]]:
        """For each level, a node's children: name, weight, and the number of a shard."""
        levels: list[dict] = [defaultdict(dict) for _ in range(3)]
        for region, rack, shard, weight in self.leaves:
            if not weight:
                continue
            names = ("", region, f"{region}/{rack}", f"{region}/{rack}/{shard}")
            for at, level in enumerate(levels):
                name, held, _ = level[names[at]].get(names[at + 1], (names[at + 1], 0.0, -1))
                level[names[at]][name] = (name, held + weight, shard if at == 2 else -1)
        return [{node: list(below.values()) for node, below in level.items()} for level in levels]


def even_tree(shards: int, built: int | None = None) -> Tree:
    """Shards 0 to ``shards`` - 1 of weight 1: the first ``built`` in racks and regions, each later one a region of its own.

    A later shard's weight then is in no other subtree, so it takes rows from all and nothing else moves.
    """
    leaves = []
    for shard in range(shards):
        rack = shard // RACK_SHARDS
        own = shard >= (shards if built is None else built)
        place = (f"added{shard}", "0") if own else (f"region{rack // REGION_RACKS}", str(rack % REGION_RACKS))
        leaves.append((*place, shard, 1.0))
    return Tree(tuple(leaves))


def _arrival(key: Column, child: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", key, child["node"]).cast("binary")), 1, BITS // 4)
    draw = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << BITS)
    return -F.log(draw) / child["weight"]


def shard_of(key: Column, tree: Tree) -> Column:
    """node (its path) and shard for a text key, by descent; the tree goes along as literals. Ties: the first name."""
    best = None
    for level in tree.children():
        listed = [
            x
            for node, below in level.items()
            for x in (
                F.lit(node),
                F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("node", "weight", "shard"), child)]) for child in below]),
            )
        ]
        parent = F.lit("") if best is None else best["node"]
        arrivals = F.transform(
            F.element_at(F.create_map(*listed), parent),
            lambda child: F.struct(_arrival(key, child).alias("arrival"), child["node"].alias("node"), child["shard"].alias("shard")),
        )
        best = F.array_min(arrivals)
    return best


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def assigned(docs: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot and grown_shard for every row of ``docs`` (doc_id, text).

    The id alone decides the shard, so equal texts part unless their ids are
    equal. The slots of a shard run from 0 in the order of id, null first, then
    text_crc32; rows equal in both have slots in no fixed order. A null text has
    no bytes, a null id draws as empty text. ``grown_shard`` is the row's shard
    in ``grown``, null without it. An empty table gives an empty result. No other
    columns are read.
    """
    text = F.coalesce("text", F.lit(""))
    at = shard_of(_key(F.col("doc_id")), tree)
    after = F.lit(None).cast("int") if grown is None else shard_of(_key(F.col("doc_id")), grown)["shard"]
    placed = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        at.alias("at"),
        after.alias("grown_shard"),
    )
    # The texts are read once; from here on rows are a few numbers. The tie breaker spreads repeated rows.
    stored = cut_lineage(placed.select("doc_id", "size", "text_crc32", "at.shard", "at.node", "grown_shard"), "placed")
    order = ["doc_id", "text_crc32", "_tie"]
    ranged = with_range_bucket(stored.withColumn("_tie", F.monotonically_increasing_id()), "shard", *order)
    ranked = with_positions(ranged, ["shard"], order, F.col("range_bucket"), position="slot")
    node = F.split("node", "/")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        node[0].alias("region"),
        node[1].alias("rack"),
        "shard",
        "slot",
        "grown_shard",
    )


def moves(docs: DataFrame, before: Tree, after: Tree) -> DataFrame:
    """from_shard, to_shard, n and bytes of the rows of ``docs`` (doc_id, text) that leave their shard from one tree to another."""
    rows = docs.select(
        shard_of(_key(F.col("doc_id")), before)["shard"].alias("from_shard"),
        shard_of(_key(F.col("doc_id")), after)["shard"].alias("to_shard"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).alias("size"),
    )
    moved = rows.filter("from_shard <> to_shard").groupBy("from_shard", "to_shard")
    return moved.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def write_shards(docs: DataFrame, tree: Tree, folder: str) -> None:
    """Write ``docs`` as Parquet below ``folder``, one folder a shard.

    Rows go to ``_shard`` folders, each shard over several tasks, so a heavy one is not written by one.
    """
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    salt = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(4))
    rows = docs.withColumn("_shard", shard_of(_key(F.col("doc_id")), tree)["shard"])
    spread = rows.repartition(int(parts), F.col("_shard"), salt)
    spread.write.partitionBy("_shard").option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
