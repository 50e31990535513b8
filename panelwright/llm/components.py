"""Connected components of links between identifiers, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large) or the smaller neighbours of every node on the least node it sees."""
    seen = edges.union(edges.select("v", "u")) if large else edges
    least = seen.groupBy("u").agg(F.min("v").alias("least"))
    near = seen.join(least, "u").select("u", "v", F.least("u", "least").alias("root"))
    moved = near.where("v > u").select(F.col("v").alias("u"), F.col("root").alias("v")) if large else near.select("v", "root").toDF("u", "v")
    if not large:
        moved = moved.union(least.toDF("u", "v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every identifier in ``links`` (a, b) but the smallest of each component.

    Each round is two joins on the links that are left, written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. A node with many links is split by the join, and minima are taken before the shuffle.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.toDF("id", "component")
        before = state
        edges = materialise(_star(_star(edges, True), False))
