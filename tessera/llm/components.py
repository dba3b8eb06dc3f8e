"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, beside, settle

#: Edges to a task: a small graph is not spread over many tasks and files, a large one over as many as it needs.
TOGETHER = 50_000


def _large_star(e: DataFrame, n: int, tasks: int) -> DataFrame:
    both = e.union(e.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return beside(both, low, "u", 2 * n).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)


def _small_star(e: DataFrame, n: int, tasks: int) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
    low = settle(low) if n > BROADCAST_ROWS else low
    moved = beside(e, low, "u", n).where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks)


def _print(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (u, v); component is its smallest node.

    Minima are partial aggregates joined back to the edges; nodes with a large share of the edges are
    joined by a broadcast of their minima, so no node's neighbours are gathered in one place.
    Loops and repeated edges don't matter, edges with a null are ignored, no edges give no rows.
    """
    e = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = _print(e)
    while was[0]:
        tasks = 2 * math.ceil(was[0] / TOGETHER)
        large = _large_star(e, was[0], tasks)
        e = settle(_small_star(settle(large) if was[0] > BROADCAST_ROWS else large, was[0], tasks))
        now = _print(e)
        if now == was:
            break
        was = now
    tops = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
