"""Connected components by alternating star contraction, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.session import durable, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node of the undirected edges; root is the smallest node reachable.

    Each round rewires every node to the smallest neighbour (large star, then small star); the number of
    rounds grows with the logarithm of the diameter. Every round is written to the shared folder, so a lost
    executor never recomputes more than one round; the round before is then deleted. The large stars are written too: the small
    stars read them twice, and the driver holds one short plan at a time. A neighbour list is only ever aggregated to its minimum.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, keep) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return (e.join(low, "a").where(keep).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                .union(low.where("a <> m").select("a", F.col("m").alias("b"))).where("a <> b").distinct())

    now = durable(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        large = durable(star(both(now), F.col("b") > F.col("a")))
        last, now = now, durable(star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), F.lit(True)))
        forget(last, large)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct().join(
            roots.select(F.col("a").alias("node")), "node", "left_anti"))
