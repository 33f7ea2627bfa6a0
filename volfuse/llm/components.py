"""Connected components of a table of links, by rounds of joins and aggregates.

Every round gives each node the smallest number among its own and its neighbours' (large star), then the
same among the smaller ones (small star); links shrink to stars around the smallest node of a component.
Rounds grow with the logarithm of the longest path. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volfuse.llm.staging import is_empty, stage


def _round(down: DataFrame) -> DataFrame:
    """Links (node, other) from larger to smaller nodes after a large and a small star.

    The smallest that a node has met is among its smaller neighbours, or itself. Either star turns both ends of a link in
    the rows of one join, so no union doubles the tasks of the shuffle behind it.
    """
    least = lambda links: links.groupBy("node").agg(F.min("other").alias("low"))
    ends = down.select(F.col("node").alias("up"), F.explode(F.array("node", "other")).alias("node"))
    large = ends.join(least(down), "node", "left").select(F.col("up").alias("node"), F.coalesce("low", "node").alias("other")).distinct()
    both = large.join(least(large), "node").select(F.explode(F.array("node", "other")).alias("node"), F.col("low").alias("other"))
    return both.where("node != other").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link, to a node without one."""
    ends = links.select(F.col("node").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(links.select(F.col("other").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    odd = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or out = 1 and into = 1")
    return is_empty(odd)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, for every node with a link."""
    down = links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other"))
    down = stage(down.where("node != other").distinct(), "links")
    while not _stars(down):
        down = stage(_round(down), "small")
    smallest = down.select(F.col("other").alias("node"), F.col("other").alias("component")).distinct()
    return down.select("node", F.col("other").alias("component")).union(smallest)
