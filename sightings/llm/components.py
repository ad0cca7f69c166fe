"""Connected components of links, by alternating large and small stars; nothing but edges and minima is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.session import staged


def _starred(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(neighbour, smallest of the node): the node's edges joined with its minimum; a hot node's edges can be split."""
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _starred(both.where("v > u"), least).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _starred(down, least).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) but the roots themselves; a root is its component's least node.

    Each round is written to the shared folder, so a lost executor costs one round at most.  The number of rounds
    grows with the logarithm of the longest chain.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = staged(_small_star(_large_star(edges).distinct()).distinct(), "stars")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
