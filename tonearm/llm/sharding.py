"""Sharding by a hierarchical weighted hash tree (operator 11).

A tree of regions, racks and shards has a weight at every shard; a rack's and a
region's weight is the sum of those below.  A document descends level by level:
every child of the node it is at draws -ln(u) / weight with u a hash of the
document's id and the child's path, and the smallest draw wins.  A child wins
in proportion to its weight, and as no draw but its own depends on its weight,
a change of weight moves documents only into or out of that child.  So a change
somewhere in the tree moves documents only between the subtrees on its path and
the others at those levels; within subtrees whose weights stay, none moves.

A shard added by ``grown`` opens a region of its own, the one place where no
older shard shares a subtree whose weight changes: it takes documents only into
itself.  The law is ``key``: the id and the tree decide, nothing else.

Placing is an expression of the id, without a shuffle.  Slots are numbered from
counts by shard and input split: no shard's rows meet in one task, so a shard
(or one id) may hold any share of the rows.

Defined results: a null id counts as the empty text; a null text is empty and
has size 1; a text of any length counts whole; rows with equal ids share a
shard, whatever their texts, and repeated rows have slots of their own; an
empty table gives no rows; other columns are not read.  Slots follow the input
splits and within them id, size and checksum; a tree needs a positive weight.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialized

#: region -> rack -> shard -> weight.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]
SHARDS = 8
LAW = "key"


def binary_tree(shards: int = SHARDS) -> dict[str, dict[str, dict[int, float]]]:
    """Equal shards, two to a rack and two racks to a region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        tree.setdefault(f"region{s // 4}", {}).setdefault(f"rack{s // 2}", {})[s] = 1.0
    return tree


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a rack and a region of its own."""
    new = 1 + max((s for racks in tree.values() for shards in racks.values() for s in shards), default=-1)
    return {**tree, f"added{new}": {f"added{new}": {new: weight}}}


def uniform(key: Column, path: Column) -> Column:
    """A number in (0, 1) that the key and the path decide."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit("draw"), key, path), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def descend(key: Column, children: Column) -> Column:
    """Of an array of children (path, weight and more), the one with the smallest draw; of equal draws that of the smaller path."""
    return F.array_min(F.transform(children, lambda c: F.struct((-F.log(uniform(key, c["path"])) / c["weight"]).alias("draw"), c["path"].alias("path"), c.alias("node"))))["node"]


def literal_tree(tree: Tree) -> Column:
    """The tree as one constant: regions with their racks and these with their shards; nodes without weight are left out."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s}", float(w), s) for s, w in shards.items() if w > 0]
            if leaves:
                made = [F.struct(F.lit(p).alias("path"), F.lit(w).alias("weight"), F.lit(s).alias("shard")) for p, w, s in leaves]
                inner.append((sum(w for _, w, _ in leaves), F.struct(F.lit(f"{region}/{rack}").alias("path"), F.lit(sum(w for _, w, _ in leaves)).alias("weight"), F.lit(rack).alias("rack"), F.array(*made).alias("shards"))))
        if inner:
            total = sum(w for w, _ in inner)
            regions.append(F.struct(F.lit(region).alias("path"), F.lit(total).alias("weight"), F.array(*[x for _, x in inner]).alias("racks")))
    if not regions:
        raise ValueError("the tree has no shard with a positive weight")
    return F.array(*regions)


def placement(key: Column, tree: Tree) -> Column:
    """region, rack and shard of a key (text)."""
    region = descend(key, literal_tree(tree))
    # One-element transforms bind each winner once, however often it is read.
    rack = lambda r: F.transform(F.array(descend(key, r["racks"])), lambda k: F.struct(r["path"].alias("region"), k["rack"].alias("rack"), descend(key, k["shards"])["shard"].alias("shard")))
    return F.get(F.flatten(F.transform(F.array(region), rack)), F.lit(0))


def placed(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """The documents' own columns in a struct ``row``, and region, rack, shard."""
    at = placement(F.coalesce(docs[key].cast("string"), F.lit("")), tree)
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), at.alias("at"))
    return out.select("row", "at.region", "at.rack", "at.shard")


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """``rows`` with a gapless number from 0 within each group, by input split and then by ``order``.

    The rows are written once, so that counts and numbers are of the same splits."""
    rows = materialized(rows.withColumn("split", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(group, "split").agg(F.count("*").alias("n"))
    starts = counts.select(F.col(group).alias("g"), F.col("split").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy(group, "split").orderBy(*order)
    out = rows.withColumn(name, F.row_number().over(own) - 1)
    return out.join(starts, (out[group] == starts["g"]) & (out["split"] == starts["s"])).withColumn(name, (F.col(name) + F.col("start")).cast("long")).drop("g", "s", "start", "split")


def shard_slots(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    tree = tree or binary_tree()
    text, key = F.coalesce(docs["text"], F.lit("")), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(LAW).alias("law"),
        placement(key, tree)["shard"].cast("int").alias("shard"), placement(key, grown(tree))["shard"].cast("int").alias("grown_shard"),
    )
    return numbered(rows, "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
