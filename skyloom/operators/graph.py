"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.plans.scratch import Scratch


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label): for each node of edges (a, b) the smallest node of its component.

    Alternating large-star and small-star steps; each is a grouped minimum with partial aggregation and
    a join back, so no neighbourhood is gathered in one place. The number of rounds grows with the
    logarithm of the longest chain. Nodes need an order (long ids). Loops are allowed, nulls are not.
    """
    spark, scratch = edges.sparkSession, Scratch(edges.sparkSession)
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    nodes = both.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = scratch.keep(both.filter("u <> v").distinct(), "e0")  # u > v
    before = None
    for k in range(most_rounds):
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("w"))
        new = small.select("u", "v").unionByName(small.select(F.col("w").alias("u"), "v")).filter("u <> v").distinct()
        e = scratch.keep(new, f"e{k + 1}")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v")), F.countDistinct("v")).first()
        if now == before:
            break
        before = now
        if k:
            scratch.drop(f"e{k - 1}")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    star = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(star, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
