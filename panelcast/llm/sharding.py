"""Placement of rows by a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import numbered, text_or_empty

#: Region, rack and shard, with the weight of every shard.
Tree = dict[str, dict[str, dict[int, float]]]
EIGHT: Tree = {
    "region-0": {"rack-0": {0: 1.0, 1: 1.0}, "rack-1": {2: 1.0, 3: 1.0}},
    "region-1": {"rack-2": {4: 1.0, 5: 1.0}, "rack-3": {6: 1.0, 7: 1.0}},
}


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own.

    In a region of its own, no weight of any other subtree changes, so every row that moves
    moves into the new shard. A shard added to an old rack would also draw rows of other
    regions into its neighbours, as the weight of their common subtree grows.
    """
    return {**tree, f"region-of-{shard}": {f"rack-of-{shard}": {shard: weight}}}


def weight_of(node) -> float:
    return float(sum(weight_of(child) for child in node.values())) if isinstance(node, dict) else float(node)


def _choose(key: Column, names: list[str], weights: list[float]) -> Column:
    """The place of the child whose exponential draw is first; a child's chance is its share of the weights."""
    draws = []
    for place, (name, weight) in enumerate(zip(names, weights, strict=True)):
        unit = (F.xxhash64(F.lit(name), key).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
        draws.append(F.struct((-F.log(unit) / F.lit(weight)).alias("cost"), F.lit(place).alias("place")))
    return F.array_min(F.array(*draws))["place"] if len(draws) > 1 else F.lit(0)


def placed(key: Column, tree, path: str = "") -> Column:
    """The shard of a key: a weighted hash draw on every level, each from the node's own name.

    A draw depends on nothing but the key, the child's name and its weight. When the
    weight of a subtree changes, its own draws change and keys enter or leave it; no key moves
    between two other subtrees.
    """
    if not isinstance(tree, dict):
        raise TypeError("a leaf has no children")
    children = sorted((str(name), name, child) for name, child in tree.items() if weight_of(child) > 0)
    if not children:
        raise ValueError("the tree has no weight")
    chosen = _choose(key, [f"{path}/{text}" for text, _, _ in children], [weight_of(child) for _, _, child in children])
    below = [placed(key, child, f"{path}/{text}") if isinstance(child, dict) else F.lit(int(name)) for text, name, child in children]
    if len(below) == 1:
        return below[0]
    out = F.when(chosen == 0, below[0])
    for place, column in enumerate(below[1:-1], 1):
        out = out.when(chosen == place, column)
    return out.otherwise(below[-1])


def sharded(docs: DataFrame, tree: Tree | None = None, more: Tree | None = None) -> DataFrame:
    """Every row in a shard of the tree, with its place in the shard and its shard in the grown tree.

    doc_id alone decides the shard, so rows of the same doc_id lie together; a null
    doc_id is a key like any other. size is the text's UTF-8 bytes plus 1, a null text has
    none. Places in a shard follow doc_id, gapless from 0; rows of one doc_id follow
    each other in any order. Texts are read once, in the scan, and not shuffled.
    An empty table gives no rows. Other columns are not read.
    """
    tree = tree or EIGHT
    more = more or grown(tree, 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards))
    text = text_or_empty()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        placed(F.col("doc_id"), tree).cast("int").alias("shard"),
        placed(F.col("doc_id"), more).cast("int").alias("grown_shard"),
    )
    return numbered(rows, ["shard"], ["doc_id"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("_index").alias("slot"), "grown_shard"
    )
