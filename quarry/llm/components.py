"""Connected components of a link table by alternating star contractions; nothing goes to the driver but whether a node is
left that is not in a star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; the component is its smallest node.

    Each round hangs the larger neighbours of a node on its smallest neighbour, then a node's smaller
    neighbours on the smallest of them; both keep the components and never add an edge, and the rounds end when
    the edges are stars (O(log n) rounds): then a node's smallest neighbour is its component. Minima are aggregated
    before the shuffle and written, a row per node; the join that follows reads nothing but two tables, so Spark sends
    a small one to all tasks or splits the rows of a hot node. The driver keeps a record of every stage and task, so
    that few of them matter: no table is shuffled twice here.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.max("v").alias("top"),
                                    F.max(F.when(F.col("v") < F.col("u"), F.col("v"))).alias("below"))
        # a node that has a smaller neighbour and any other one is not in a star
        low = written(low.select("u", "m", F.expr("m < u and (m <> below or top > u)").alias("apart")), "low")
        if low.where("apart").isEmpty():
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = edges.join(low.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v"))
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(low.select("u", F.col("m").alias("v")).union(small), "edges")
