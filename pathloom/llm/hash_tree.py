"""Sharding by descending a tree of regions, racks and shards with weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pathloom.llm.common import saved
from pathloom.operators.numbering import number_rows


@dataclass(frozen=True)
class Leaf:
    """A shard and its place in the tree. A weight of zero or less takes no rows."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 2, racks: int = 2) -> list[Leaf]:
    """``shards`` leaves of weight one: ``per_rack`` to a rack, ``racks`` to a region, in order."""
    return [Leaf(f"r{s // (per_rack * racks)}", f"k{s // per_rack % racks}", s) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region of its own: all draws of the others stay, so rows move into it only."""
    shard = max((leaf.shard for leaf in tree), default=-1) + 1
    taken = {leaf.region for leaf in tree}
    name = next(n for n in (f"r{shard}" + "+" * k for k in range(len(taken) + 1)) if n not in taken)
    return [*tree, Leaf(name, "k0", shard, weight)]


def _nested(tree: list[Leaf]) -> Column:
    """The tree as one literal: arrays of (path, weight, below); the weight of a node is that of its leaves."""
    if len({leaf.shard for leaf in tree}) < len(tree):
        raise ValueError("a shard has several places in the tree")
    used = [leaf for leaf in tree if leaf.weight > 0]
    if not used:
        raise ValueError("no shard has a weight above zero")

    def node(path: str, leaves: list[Leaf], below: Column) -> Column:
        weight = float(sum(leaf.weight for leaf in leaves))
        return F.struct(F.lit(path).alias("path"), F.lit(weight).alias("weight"), below.alias("below"))

    regions = []
    for region in dict.fromkeys(leaf.region for leaf in used):
        of_region = [leaf for leaf in used if leaf.region == region]
        racks = []
        for rack in dict.fromkeys(leaf.rack for leaf in of_region):
            of_rack = [leaf for leaf in of_region if leaf.rack == rack]
            shards = [node(f"{region}.{rack}.{leaf.shard}", [leaf], F.lit(leaf.shard)) for leaf in of_rack]
            racks.append(node(f"{region}.{rack}", of_rack, F.array(*shards)))
        regions.append(node(region, of_region, F.array(*racks)))
    return F.array(*regions)


def _draw(key: Column, path: Column, weight: Column) -> Column:
    """ln(u) / weight, u uniform over (0, 1] from 52 bits of a digest of node and key.

    The node with the highest draw wins in proportion to its weight. A draw depends on its own node and
    weight only: if a weight rises, keys move to its node and between no others.
    """
    digest = F.substring(F.md5(F.concat(path, F.lit("/"), key)), 1, 13)
    u = (F.conv(digest, 16, 10).cast("long") + 1).cast("double") / F.lit(float(1 << 52))
    return F.log(u) / weight


def _descend(key: Column, children: Column) -> Column:
    """``below`` of the child with the highest draw; of equal draws the first."""
    draws = F.transform(children, lambda c, i: F.struct(_draw(key, c["path"], c["weight"]).alias("draw"), (-i).alias("place")))
    return F.get(children, -F.array_max(draws)["place"])["below"]


def shard_of(key: str | Column, tree: list[Leaf]) -> Column:
    """The shard of a key: the key's text and the tree decide, nothing else. Null counts as the empty text."""
    key = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return _descend(key, _descend(key, _descend(key, _nested(tree))))


def assign(df: DataFrame, tree: list[Leaf], key: str = "doc_id", name: str = "shard") -> DataFrame:
    """All rows and columns of ``df`` plus ``name``; an own column of that name is replaced.

    No shuffle. Rows of one key share a shard, null keys too; an empty frame stays empty.
    """
    return df.withColumn(name, shard_of(key, tree))


def write_shards(df: DataFrame, tree: list[Leaf], path: str, key: str = "doc_id") -> None:
    """Whole rows as Parquet below ``path``, one folder a shard.

    ``rebalance`` splits a shard at the advisory partition size, so one that holds a hot key is many files.
    """
    assign(df, tree, key).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def shard_table(df: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) for each row.

    ``size``: UTF-8 bytes of the text plus one, null has none; ``text_crc32``: of these bytes.
    ``slot`` counts from 0 within the shard in the order of key, size and checksum (rows equal in all in any
    order). Texts are read once; their short rows are written, then sorted over all tasks by all these
    columns and a row number, so neither a shard nor a repeated key is one task. ``grown_shard``: the shard
    under ``grown``, null without. Null keys sort first. Other columns are left out; an empty frame gives none.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    bare = df.select(
        F.col(key).alias("key"),
        (F.octet_length(content).cast("long") + 1).alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = saved(bare, "shards")
    numbered = number_rows(placed, "shard", ["key", "size", "text_crc32", "row"])
    starts = numbered.groupBy("shard").agg(F.min("n").alias("start"))
    # One row per shard.
    slots = numbered.join(F.broadcast(starts), "shard")
    return slots.select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("n") - F.col("start")).alias("slot"), "grown_shard"
    )
