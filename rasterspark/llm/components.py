"""Connected components of an edge table, by alternating star contraction.

Every round is a partial aggregation (the least neighbour of each node) and an
equi-join, so a node with very many edges is pre-aggregated where its edges lie
and its join partition can be split. Each round is checkpointed in the shared
folder. Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of longs, ``u != v`` -> ``(u, root)`` for each node that has an edge.

    ``root`` is the least node of the component; the root itself has a row too.
    An empty edge table gives an empty result.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct())
    before = _state(edges)
    while before[0]:
        edges = cut(_small_star(_large_star(edges)))
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select("u", F.col("v").alias("root")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
