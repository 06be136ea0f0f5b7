"""Connected components by alternating star contractions, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Points neighbours to the least of a node's neighbourhood: the larger neighbours (large), or the smaller and the node."""
    ways = edges.select("u", "v")
    if large:
        ways = ways.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = ways.join(least, ways.u == least.c)
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    out = out.filter("u <> v")
    return out if large else out.distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link: component is the least node it can reach. Links are undirected;
    loops, repeats and links with a null are ignored. Every round is checkpointed; nothing reaches the driver but sums."""
    edges = checkpoint(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        edges = checkpoint(_stars(_stars(edges, True), False))
        # Stars stand apart once no centre hangs on another and no node on two.
        tops = edges.select(F.col("v").alias("top")).distinct()
        if edges.join(tops, F.col("u") == F.col("top"), "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
