"""Weighted hash tree: which rows move, shares by weight, slots, odd rows."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import hash_tree
from pathloom.llm.hash_tree import Leaf, assign, even_tree, grow, shard_table


def places(spark, tree, n=4000):
    return {r[0]: r[1] for r in assign(spark.range(n).withColumnRenamed("id", "doc_id"), tree).collect()}


def brute(key, tree):
    """The descent in plain Python."""

    def best(nodes):
        def draw(path, weight):
            return math.log((int(hashlib.md5(f"{path}/{key}".encode()).hexdigest()[:13], 16) + 1) / 2**52) / weight

        return max(nodes, key=lambda node: draw(*node))[0]

    def weigh(paths, leaves):
        return [(p, sum(w for q, w in leaves if q == p)) for p in dict.fromkeys(paths)]

    used = [leaf for leaf in tree if leaf.weight > 0]
    region = best(weigh([v.region for v in used], [(v.region, v.weight) for v in used]))
    used = [v for v in used if v.region == region]
    rack = best(weigh([f"{v.region}.{v.rack}" for v in used], [(f"{v.region}.{v.rack}", v.weight) for v in used]))
    used = [v for v in used if f"{v.region}.{v.rack}" == rack]
    path = best([(f"{rack}.{v.shard}", v.weight) for v in used])
    return int(path.rsplit(".", 1)[1])


def test_descent_is_what_plain_python_gives(spark):
    tree = [Leaf("a", "x", 3, 2.0), Leaf("a", "y", 1, 0.5), Leaf("b", "x", 7, 1.0), Leaf("b", "x", 2, 0.0), Leaf("b", "x", 9, 4.0)]
    got = places(spark, tree, 500)
    assert got == {key: brute(key, tree) for key in range(500)}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    tree = even_tree(5)
    before = places(spark, tree)
    for _ in range(4):
        tree = grow(tree)
        after = places(spark, tree)
        new = tree[-1].shard
        moved = {k for k in after if after[k] != before[k]}
        assert {after[k] for k in moved} == {new}
        assert abs(len(moved) - 4000 / len(tree)) < 200
        before = after


def test_movement_stays_in_the_subtree_whose_weight_changes(spark):
    tree = even_tree(12)
    heavier = [Leaf(v.region, v.rack, v.shard, 3.0 if v.shard == 5 else v.weight) for v in tree]
    region, rack = {v.shard: v.region for v in tree}, {v.shard: (v.region, v.rack) for v in tree}
    before, after = places(spark, tree), places(spark, heavier)
    for key, old in before.items():
        new = after[key]
        if new == old:
            continue
        assert region[new] == region[5]  # nothing moves between or into other regions
        if region[old] == region[5]:
            assert rack[new] == rack[5]  # nor between the other racks of this one
        if rack[old] == rack[5]:
            assert new == 5
    lighter = places(spark, [Leaf(v.region, v.rack, v.shard, 0.0 if v.shard == 5 else 1.0) for v in tree])
    assert all(region[before[k]] == region[5] for k in before if lighter[k] != before[k])


def test_shares_follow_weights(spark):
    tree = [Leaf("a", "x", 0, 1.0), Leaf("a", "y", 1, 3.0), Leaf("b", "x", 2, 4.0)]
    share = Counter(places(spark, tree, 8000).values())
    assert abs(share[0] - 1000) < 150 and abs(share[1] - 3000) < 250 and abs(share[2] - 4000) < 250


def test_trees_that_cannot_be(spark):
    for tree in ([], [Leaf("a", "x", 1, 0.0)], [Leaf("a", "x", 1), Leaf("b", "x", 1)]):
        with pytest.raises(ValueError):
            assign(spark.range(1).withColumnRenamed("id", "doc_id"), tree)
    assert [v.region for v in grow([Leaf("r1", "x", 0)])] == ["r1", "r1+"]


def test_slots_sizes_and_odd_rows(frame):
    rows = [(i, f"té {i}" * (i % 7), "own") for i in range(200)] + [(5, "again", "x"), (None, None, None), (None, "x", "y"), (9, "é" * 200_000, "long")]
    rows += [(77, "copy", "hot")] * 150
    df = frame(rows, "doc_id long, text string, shard string")
    tree = even_tree(4)
    out = shard_table(df, tree, grow(tree)).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append((r.slot, r.doc_id is not None, r.doc_id or 0, r.size))
        assert r.shard == brute("" if r.doc_id is None else r.doc_id, tree) and r.grown_shard in (r.shard, 4)
    for of_shard in by_shard.values():
        of_shard.sort()
        assert [s for s, *_ in of_shard] == list(range(len(of_shard)))
        assert [k[1:] for k in of_shard] == sorted(k[1:] for k in of_shard)
    alone = shard_table(df, tree).where("grown_shard is not null").count()
    assert alone == 0 and shard_table(df.limit(0), tree).count() == 0


def test_writing_whole_rows_and_replacing_a_column(frame, spark, tmp_path):
    df = frame([(i, f"text {i}", "own") for i in range(50)], "doc_id long, text string, shard string")
    assert assign(df, even_tree(3)).columns == df.columns
    hash_tree.write_shards(df, even_tree(3), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select("doc_id", "text").orderBy("doc_id").collect() == df.select("doc_id", "text").orderBy("doc_id").collect()
    assert back.where(F.col("shard") != hash_tree.shard_of("doc_id", even_tree(3))).count() == 0
