"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import saved


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node of ``edges`` (long columns a, b); component is the smallest node.

    Each round lets every node hang its larger neighbours on its smallest neighbour, then
    its smaller ones; the number of rounds grows with the logarithm of the longest path. An
    edge table of a round is written to the shared folder, so a lost executor repeats one
    round at most. Hubs are joined with one row per node, which Spark may split when skewed.
    Loops are ignored; nulls too. Raises if it has not converged after ``most_rounds``.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = saved(edges.where("a <> b").select(*ends).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_least(both), "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        )
        large = saved(large, "edges")
        hung = large.join(_least(large), "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = saved(hung.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        state = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


class Forest:
    """Union-find over 0..n-1 whose links are a spanning forest of the links it was given."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, pairs) -> list[tuple[int, int]]:
        """The pairs that join two trees."""
        kept = []
        for a, b in pairs:
            x, y = self.root(a), self.root(b)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                kept.append((a, b))
        return kept
