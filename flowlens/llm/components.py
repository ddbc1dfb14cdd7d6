"""Connected components by alternating stars, one written table per step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of an edge (a, b) reaches.

    Each step hooks neighbours to the smallest one, first the larger then the smaller neighbours, which leaves
    one star per component after few steps. Minima are taken before the shuffle, and the joins are plain inner
    joins, whose hot keys Spark splits. Nodes may have any type that has an order; null edges are left out.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(steps):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # The smallest edge of every node stays, so that no node is lost.
        large = staged(large.unionByName(low.filter("u <> m").select("u", F.col("m").alias("v"))).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        last, mark = mark, _mark(now)
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
