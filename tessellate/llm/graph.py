"""Connected components of an edge table, without gathering it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import released, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's neighbours are re-attached to the smallest one.

    The large step moves larger neighbours, the small step moves smaller ones.
    The minimum is a map-side-combined aggregate of one row a node, and the join back
    splits when a hub is skewed, so no node's neighbours meet in one place.
    """
    if large:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = arcs.join(low, "u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return moved.filter("a <> b").distinct()


def edges_of(parts: DataFrame) -> DataFrame:
    """components(node, root) as edges again, which link the same nodes in fewer rounds than those that they come from."""
    return parts.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root): root is the smallest node reachable; nodes without an edge have no row.

    Alternating star contraction; every round is a table in the shared folder, and the
    rounds end when the edge set no longer changes (logarithmic in the longest chain).
    """
    now = stored(edges.filter("a <> b").select("a", "b"), "edges")
    seen = None
    while True:
        now = released(stored(_star(_star(now, True), False), "edges"), now)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        seen = mark
