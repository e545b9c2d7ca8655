"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reportloom.session import cut_lineage


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of every node with the least of them (and itself).

    Large star moves the greater neighbours, small star the lesser ones and the node. The least neighbour is an
    aggregate stored before the join, so a hub with very many links is pre-aggregated and its rows can be split.
    """
    if small:
        directed = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        directed = edges.union(edges.select("b", "a"))
    least = cut_lineage(directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
    joined = directed.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return cut_lineage(moved.filter("a <> b").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every greater node ``a`` has one link and is nobody's lesser node ``b``. Runs jobs."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counts.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node it can reach, for every node of a link to another node.

    ``links`` has ``a`` and ``b`` of one ordered type; direction, repeats, nulls and links of a node with itself do not
    matter. Runs jobs: the rounds grow with the logarithm of the number of nodes, every round is stored. Links that are
    stars around their least nodes already take no round, and none is run only to see that nothing moves.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while not _are_stars(edges):
        edges = _star(_star(edges, small=False), small=True)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
