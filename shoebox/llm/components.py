"""Connected components of link tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.session import cut


def spanning_forest(links: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Root of every node that some link joins to a lesser one, for as many links as one task holds."""
    above: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while top in above:
            top = above[top]
        while x != top:
            above[x], x = top, above[x]
        return top

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(above)}


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for both ends of the links ``a, b``; the root is the least node that can be reached.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least of them
    (large and small stars), so that even a chain is settled in few rounds. Every round is a
    table in the shared folder. Links from a node to itself are allowed and keep the node.
    """
    alone = links.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node")).distinct()
    down = cut(
        links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    before = None
    while True:
        sign = tuple(down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            break
        before = sign
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        down = cut(small.filter(F.col("u") != F.col("v")).distinct(), "stars")
    rooted = down.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = down.select(F.col("v").alias("node")).unionByName(alone).distinct().join(rooted, "node", "left_anti")
    return rooted.unionByName(roots.withColumn("root", F.col("node")))
