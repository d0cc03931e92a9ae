"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .storage import materialise, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``; root is the smallest node it reaches.

    Each round lets every node pass on the smallest of its neighbours, found by a grouped minimum and
    a join, so no neighbourhood is ever gathered in one task. The tables shrink to stars in a number of
    rounds that grows with the logarithm of the largest component.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        # written before the join: both sides are then shuffled for it alone, so a hub's neighbours can be split among tasks
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", "m")).distinct()
        after = materialise(small, "edges")
        release(edges, low)
        edges, now = after, _state(after)
        if now == before:
            break
        before = now
    roots = edges.groupBy("hi").agg(F.min("lo").alias("root"))
    return roots.select(F.col("hi").alias("node"), "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
