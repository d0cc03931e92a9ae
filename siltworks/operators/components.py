"""Connected components of nodes that share keys, by least labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def components(edges: DataFrame, keep: Callable[[str, DataFrame], DataFrame]) -> DataFrame:
    """``node, label``: the least node that a node reaches over shared keys.

    ``edges`` has node and key; nulls link nothing. A round takes each key's least label, each node's least of its keys' labels, and
    then the label of that label, so long chains halve. Keys only pass on one row each: a key of very many nodes is summed up
    where its rows are. ``keep`` writes what the next step reads twice; the driver sees one count a round.
    """
    own = keep("edges", edges.where("node is not null and key is not null").select("node", "key").distinct())
    labels = keep("labels-0", own.select("node").distinct().withColumn("label", F.col("node")))
    k = 0
    while True:
        k += 1
        by_key = keep(f"keys-{k}", own.join(labels, "node").groupBy("key").agg(F.min("label").alias("low")))
        lower = keep(f"lower-{k}", own.join(by_key, "key").groupBy("node").agg(F.min("low").alias("label")))
        far = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = keep(f"labels-{k}", lower.join(far, "label").select("node", F.least("label", "further").alias("label")))
        moved = after.withColumnRenamed("label", "now").join(labels, "node").where("now != label").limit(1).count()
        labels = after
        if not moved:
            return labels
