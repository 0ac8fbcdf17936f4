"""Connected components of a distributed graph by alternating large-star and small-star steps.

Each step groups edges by a node, takes the least neighbour with partial aggregation, and joins it back, so a node of
any degree is dealt over tasks. Edges point to smaller nodes and keep components whole; when each node has one edge or only
such as point to it, all are stars, and each node points to the least of its component. That is seen by one aggregation,
without another round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges from larger to smaller nodes."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), longs -> node, label: the least node of its component; nodes that are that themselves are left out."""
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(edges):
        edges = cut(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))


def _stars(edges: DataFrame) -> bool:
    """Whether no node with an edge to a smaller one has another edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.out").alias("out"), F.count(F.lit(1)).alias("all")).filter("out > 0 and all > 1").isEmpty()
