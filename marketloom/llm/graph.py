"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketloom.llm.common import joined, written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): each node of edges (a, b: long) with the least node that it reaches.

    Large-star and small-star rounds: every node first hands its greater neighbours, then its lesser ones to the least
    node around it, until all edges point to a least node. A node's least neighbour is found by an aggregate with map-side
    combination and goes back to very many edges of one node by broadcast, so no task holds all edges of a node. Rounds
    grow with the logarithm of the graph's diameter; each is a table in the shared folder. Self-loops and repeated edges
    change nothing; without edges there are no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    n = now.count()
    if not n:
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("k"))
        large = joined(both.where("v > u"), least, "u", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        parent = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = joined(large, parent, "u", large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(parent.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "small-star")
        # a forest of stars: each node has one parent and no parent has one
        state = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        n = state["n"]
        if n == state["d"] and now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
