"""Connected components of an undirected graph given as a table of links, by alternating large and small stars.

Every round is two aggregations and joins over the links; links shrink to stars
in a few rounds. They end when the links are stars. Nothing is gathered
at the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's larger (or other smaller) neighbours to the least node of its neighbourhood."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("_m"), F.count("*").alias("_n")).select("a", F.least("a", "_m").alias("_m"), "_n")
    # the centre of a star may have most nodes as neighbours
    joined = join_groups(near, least, "a", "b", "_n")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        moved = joined.where(F.col("b") != F.col("_m")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("_m").alias("b")))
    return moved.where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the links (larger node first) are stars already: one link a node, and no node both a leaf and a centre."""
    links, leaves = edges.agg(F.count("*"), F.countDistinct("a")).first()
    if links != leaves:
        return False
    centres = edges.select("b").distinct()
    return not centres.join(edges.select(F.col("a").alias("_a")), F.col("b") == F.col("_a"), "left_semi").head(1)


def components(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``node`` and ``component`` (its least node) for every node that has a link."""
    links = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    links = settle(links, name)
    while not _settled(links):
        links = settle(_star(links, large=True), name)
        links = settle(_star(links, large=False), name)
    # now every link joins a node to the least of its component
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
