"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import durable


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node reachable.

    Alternates the large-star and small-star steps until the edges are stars around the smallest nodes. Each step joins edges
    with one row per node, so a node with many edges is dealt over several tasks by adaptive skew handling; its minimum is
    pre-aggregated. Each round is written to the checkpoint folder. Rows with a null end are no edges; no edges give no rows.
    """
    stars = durable(_turned(edges.where("u != v")).distinct())
    seen = _digest(stars)
    while seen[0]:
        stars = durable(_small_star(_large_star(stars)))
        digest = _digest(stars)
        if digest == seen:
            break
        seen = digest
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _turned(edges: DataFrame) -> DataFrame:
    """Each edge from its larger end u to its smaller end v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node with the smallest node among it and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()
