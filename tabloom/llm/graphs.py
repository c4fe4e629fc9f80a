"""Connected components by alternating stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), the component being its smallest node.

    Large-star and small-star steps alternate until every node hangs on the
    smallest one it can reach.  Neighbourhoods are only reduced to their
    minimum, before the shuffle, so a node with very many links is no hot
    task.  Each round is a written table, so lost executors cost one round.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links, "links")
    while not _stars(links):
        links = stored(_small_star(_large_star(links)), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select("v", "v").distinct())


def _stars(links: DataFrame) -> bool:
    """Whether each upper node has one link, and none to a node that has one itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(links.select("v", F.lit(0)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 or (up = 1 and least = 0)")
    return odd.count() == 0


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", "m")).distinct()
