"""Connected components of a link table by alternating large-star and small-star steps, staged between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.session import stage, unstage


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Every node hangs on one other, and none of those hangs on a third."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("c"), F.lit(0).alias("p")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("c"), F.lit(1).alias("p")))).alias("e"))
    nodes = ends.groupBy("e.node").agg(F.sum("e.c").alias("c"), F.max("e.p").alias("p"))
    return nodes.filter("c > 1 or c = 1 and p = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """From links ``(a, b)`` to ``(node, component)``, the smallest node reachable, for each node that has a link.

    Every step groups by node with a partial minimum and joins the minimum
    back, so a node with very many links is split by the skew join.  Each round
    is written to the shared folder; the number of rounds grows with the
    logarithm of the longest path.  Without links the result is empty.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links"
    )
    while not _is_settled(edges):
        after = stage(_small(_large(edges)), "links")
        unstage(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
