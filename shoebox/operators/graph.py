"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut


def _all_stars(edges: DataFrame) -> bool:
    """Every node has at most one link down, and then none up to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    seen = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.filter((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).isEmpty()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, label`` with the least node of each connected component.

    Large-star and small-star steps alternate until nothing changes, which takes few rounds
    even on long chains.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _all_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        linked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        edges = cut(linked.filter(F.col("u") != F.col("v")).distinct(), "star")
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    return nodes.join(labels.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("label", "node").alias("label")
    )
