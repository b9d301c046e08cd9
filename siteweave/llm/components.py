"""Connected components of an edge table by alternating star contractions, every round on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.store import store


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge; ``root`` is the smallest reachable node.

    A large-star step links each node's larger neighbours to its smallest one, a
    small-star step does so for the smaller neighbours; both keep components
    and end, after about log n rounds, in stars.  No node's neighbours are
    collected: each step is a minimum per node, combined before its shuffle,
    joined back to the edges.
    """
    now = store(_down(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store(_down(large), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        now = store(_down(small), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Has every larger node one edge, and is no smaller node a larger one elsewhere?"""
    sides = edges.select("u", F.lit(1).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("n")).distinct())
    return not sides.groupBy("u").agg(F.sum("n").alias("n"), F.count("*").alias("sides")).where("n > 1 or n = 1 and sides > 1").limit(1).count()


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
