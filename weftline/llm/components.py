"""Connected components of a distributed link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import discard, hot_join, materialised


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node's larger neighbours are hung on the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return hot_join(both.where("v > u"), least, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node and its smaller neighbours are hung on the smallest of them; edges point from the larger to the smaller node."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hung = hot_join(edges, least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other at most, and none hangs on a node that hangs itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("low")))
    return ends.groupBy("x").agg(F.sum("low").alias("hangs"), F.min("low").alias("least")).where("hangs > 1 or hangs > 0 and least = 0").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Of each node of ``links`` (columns ``a``, ``b``: longs) the smallest node it reaches: node, component_id.

    Self-links and links with a null end are ignored, repeated links count once;
    a node without other links isn't in the result.  Each round is written to the
    shared folder, and the one before deleted; only row counts reach the driver.
    A hub's links stay where they are.  The number of rounds grows with the
    logarithm of the longest chain.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u <> v").distinct()
    edges = materialised(edges, "links")
    while not _stars(edges):
        last, total = edges, edges.count()
        edges = materialised(_small_star(_large_star(last, total), total), "stars")
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())
