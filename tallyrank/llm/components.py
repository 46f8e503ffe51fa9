"""Connected components of an edge list by star contraction, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)``; ``root`` is the least
    node of its component. Isolated nodes must be added by the caller.

    Alternating large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the least node it sees, until all
    edges point at a root. A step is one partial aggregate per node and one
    join with it, so a node with any number of neighbours is never gathered
    in one place. Every step is written to the shared checkpoint folder.
    ``max_rounds`` only guards against a defect: the number of rounds grows
    with the logarithm of the longest path, and passing it is an error.
    """
    e = cut(edges.filter(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        nb = _neighbours(e)
        least = nb.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (nb.join(least, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct())
        # Small star: every node tells its smaller neighbours and itself the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v")))
                 .filter(F.col("u") != F.col("v")).distinct())
        e = cut(small)
        row = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
        if state == (row["n"], row["h"]):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (row["n"], row["h"])
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
