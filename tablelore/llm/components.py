"""Connected components of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import settle


def _are_stars(links: DataFrame) -> bool:
    """Whether every node above another hangs on that one only, and nothing hangs on it."""
    ends = links.selectExpr("stack(2, a, 1, b, 0) AS (node, up)").groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return ends.where("up > 0 AND n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is the smallest node it can reach.

    Each round hangs the neighbours of every node on its smallest neighbour, first those above the node, then those below. Only
    links move; minima are summed up before the shuffle, so a node with a third of all links costs one row a task there. Rounds
    grow with the logarithm of the longest chain; there are none beyond those that make all links stars. Nulls and loops take no part.
    """
    links = settle(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.where("a <> b").distinct(), "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = settle(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
