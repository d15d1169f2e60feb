"""Connected components by alternating large-star and small-star rounds.

Every step is a grouped minimum (combined before its shuffle) and an equi-join with one row for each
key, which adaptive execution can split where a star's centre is hot.  Rounds are written to the
shared folder, so no lineage grows and no link reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = both.where("v > u").join(least, "u")
    return far.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    near = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link to another node; component is the smallest node.

    Null ends, self links, repeated and reversed links are allowed and change nothing.  An empty
    table gives an empty result.
    """
    a, b = edges[a], edges[b]
    now = written(edges.where((a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        large = _large_star(now).where("u != v").distinct()
        after = written(_small_star(large).where("u != v").distinct())
        drop(now)
        now, before = after, mark
        mark = _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
