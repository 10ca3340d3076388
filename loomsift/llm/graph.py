"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsift.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Each round, every node first hands its larger neighbours to the smallest node it
    knows (large star), then its smaller ones (small star).  Nodes that already point at
    their root only cost a row.  No set of neighbours is gathered: the smallest one is an
    aggregate, joined back to the edges, so a node with very many edges is split like any
    skewed join.  Every round ends in the shared folder.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        # Large star over both directions, then small star over (larger, smaller).
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        after = written(small, "edges")
        # Stars everywhere: no node is both a leaf and a root, and no leaf has two roots.
        leaves = after.groupBy("u").agg(F.count("*").alias("n"))
        loose = leaves.where("n > 1").limit(1).count() or after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        now = after
        if not loose:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
