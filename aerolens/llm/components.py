"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """u, m: the smallest of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars(links: DataFrame) -> bool:
    """Whether every id links to one smaller id that links nowhere itself."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the smallest id reachable.

    Every step keeps the graph connected as it was and links ids to smaller ones,
    until all point at their component. Rows stay linear in the edges; a hub's
    rows are joined to one row, which Spark can split. No edges: no rows. The result
    reads a table of work.
    """
    links = work.staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = work.staged(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "links")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
