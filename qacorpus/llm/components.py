"""Distributed union-find: connected components of an edge table, by alternating star contraction.

Every round hooks all larger neighbours of a node to its smallest neighbour and then all smaller ones (large star, small star).
Minima are combined before the shuffle and joined back as written tables, so a node with very many neighbours is no task of its
own.  Rounds grow with the logarithm of the longest chain.  Every round is written to the shared folder, the
round before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, staged


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Every node hangs on one root, and no root hangs on another.  As edges go down, roots are the smallest of their component."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    open_ = F.col("up") + F.col("root") > 1
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where(open_ & (F.col("up") > 0)).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges`` (``u, v``, any order, loops ignored).

    Nodes without an edge are not in the result.  An empty edge table gives an empty result.
    """
    now = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        # large star: every larger neighbour gets the smallest node of the neighbourhood
        around = _both(now)
        first_low = staged(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = around.where("v > u").join(first_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = staged(large, "large")
        # small star: a node and its smaller neighbours get the smallest of them
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, staged(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(before, first_low, low, large)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("u", F.col("u").alias("component")))
