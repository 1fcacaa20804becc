"""Connected components by least labels and pointer jumps; every step is a join or an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b).

    A round takes the least label among a node and its neighbours, then that label's own label, and is
    checkpointed; it ends when no label changes, after about as many rounds as the logarithm of the longest
    path. A hub meets its neighbours in joins, which adaptive execution splits, and in least-label
    aggregates, which combine before the shuffle; its neighbours are never listed in one row.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), True)
    least = F.min("label").alias("label")
    labels = checkpointed(both.select(F.col("a").alias("node"), F.least("a", "b").alias("label")).groupBy("node").agg(least, F.lit(True).alias("changed")), True)
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        hooked = near.union(own).groupBy("node").agg(least, F.max("old").alias("old"))
        over = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = hooked.join(over, "label").select("node", F.least("label", "next").alias("label"), "old")
        labels = checkpointed(jumped.select("node", "label", (F.col("old") != F.col("label")).alias("changed")), True)
    return labels.select("node", F.col("label").alias("component"))
