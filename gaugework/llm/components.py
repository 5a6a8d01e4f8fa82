"""Connected components by alternating large-star and small-star steps, as joins and partial minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm.common import materialize


def _all_stars(edges: DataFrame) -> bool:
    """Whether every edge (u, v) leads from a node without another edge to one that no edge leaves."""
    side = lambda name, leaves, met: edges.select(F.col(name).alias("node"), F.lit(leaves).alias("leaves"), F.lit(met).alias("met"))
    nodes = side("u", 1, 0).unionByName(side("v", 0, 1)).groupBy("node").agg(F.sum("leaves").alias("leaves"), F.max("met").alias("met"))
    return nodes.agg(F.count_if(F.expr("leaves > 1 or leaves = 1 and met = 1"))).first()[0] == 0


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """edges (a long, b long) -> (node long, component long) for every node of an edge; component is its least node.

    No node's neighbours are gathered: each step is a minimum per node and a join, so a node with a
    third of all edges only makes a long partition that a skewed join splits.  Self-loops and repeated
    edges are allowed.  An empty table gives an empty table.  Edges that are stars to least nodes take no step.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    for _ in range(rounds):
        if _all_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
