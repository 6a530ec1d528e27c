"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Each node is tied to the least of its neighbours and itself; the large step moves greater neighbours, the small step the others."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    pairs = edges.filter("a > b").unionByName(back.filter("a > b")) if small else edges.unionByName(back)
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    if small:
        moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = pairs.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _unfinished(edges: DataFrame) -> bool:
    """Whether some node hangs on two others, or on one that hangs on another itself: else all edges (a, b) form stars around b."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.filter("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component: the least node of its component.

    Each round is written to the shared folder, so lineage stays short. A node with very many edges only meets a sum of
    its least neighbour, and joins that Spark can split.
    """
    now = common.materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while _unfinished(now):
        last = now
        now = common.materialize(_stars(_stars(last, small=False), small=True), "edges")
        common.discard(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
