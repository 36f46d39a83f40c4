"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is a few aggregations and joins, written to the checkpoint folder; nothing is
collected but counts. Links shrink towards stars whose centre is the smallest node. A centre may
have any number of links: what the centres with the most links found is sent to these. Once at most
FEW links are left, one task follows them all: a round has dozens of stages, however few the links.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import cut, join_hot, rows_in

FEW = 50_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return join_hot(around.where("b > a"), least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = join_hot(down, least, ["a"], "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def follow(edges: DataFrame) -> DataFrame:
    """(node, root) of edges, in one task."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches):
        up: dict = {}

        def top(x):
            while (over := up.setdefault(x, x)) != x:
                up[x] = x = up[over]
            return x

        types = None
        for batch in batches:
            types = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_arrays([pa.array(list(up), types), pa.array([top(x) for x in list(up)], types)], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    edges: columns a and b of one orderable type. Loops and repeated links do no harm.
    """
    edges = cut(edges.select("a", "b").where("a <> b").distinct())
    if rows_in(edges) <= FEW:
        return follow(edges)
    mark = None
    for _ in range(max_rounds):
        edges = cut(small_star(large_star(edges)))
        # A star forest has no node that is both a leaf and a centre, and one centre for each leaf.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == tuple(now):
            break
        if now[0] <= FEW:
            return follow(edges)
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
