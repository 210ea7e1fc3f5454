"""Connected components of a graph given as an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def _jumped(step: DataFrame) -> DataFrame:
    """``step`` (node, root) followed to its ends by pointer jumping: the ways halve with each jump."""
    while True:
        further = step.select(F.col("node").alias("root"), F.col("root").alias("end"))
        jumped = cut(step.join(further, "root").select("node", F.col("end").alias("root"), (F.col("end") != F.col("root")).alias("moved")), "jump")
        step = jumped.drop("moved")
        if not jumped.where("moved").take(1):
            return step


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long): root is the least node of its component.

    Each round maps every node to the least within two steps of it, follows that map to its ends (some
    log2 of the longest way jumps), and contracts the edges by it. Two ends never share a neighbour, so a round halves the
    nodes at least: there are log2(n) rounds at most, one for stars and sorted chains and some log5(n) for shuffled
    chains. The maps are composed at the end. Each round's tables are written to the shared folder.
    """
    maps = []
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        one = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "near")
        two = both.join(one.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("root"))
        step = _jumped(cut(two.select(F.col("a").alias("node"), F.least("a", "root").alias("root")), "step"))
        maps.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("root").alias("ra")), step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").where("ra <> rb")
        edges = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = cut(step.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
    return out
