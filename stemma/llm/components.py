"""Connected components by alternating stars, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.common import staged


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> node, component (its least node), for all nodes with an edge to another, as a staged table.

    Large-star hangs every greater neighbour on a node's least one, small-star hangs lesser ones there; the
    two alternate until nothing changes, which takes about the logarithm of the longest path. Least
    neighbours are aggregates with partial sums, and a node with many edges is split by the join.

    Edges with a null end, and from a node to itself, count for nothing; repeated ones count once. No edges:
    no rows.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large", edges)
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = staged(small, "small", large)
        after = _sum(edges)
        if after == before:
            break
        before = after
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return staged(nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct()), "components", edges)
