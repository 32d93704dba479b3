"""Connected components of a link table, by alternating joins on the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links`` (a, b long): root is the smallest node reachable.

    Large-star and small-star steps: every round hangs each node's larger neighbours, then its smaller ones, on its
    smallest neighbour, until only stars are left. Rounds grow with the logarithm of the longest path. Each round is a
    written table; no group is gathered.
    """
    edges = stage(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges")
    before = None
    while True:
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(small, "hi")
        edges = stage(
            hung.select(F.col("m").alias("lo"), "hi").union(hung.select("m", "lo").where("m < lo")).distinct(),
            "edges",
        )
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if (state["n"], state["s"]) == before:
            break
        before = (state["n"], state["s"])
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
