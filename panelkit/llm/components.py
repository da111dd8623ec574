"""Connected components of a link table by falling labels with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of the links.

    Each step lowers a node's label to the least among its neighbours and hands it on to
    the node that its old label names, so long chains shorten by half. Labels are
    aggregated before the shuffle, so a node with very many links is no hot task."""
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    edges = stored(both.union(both.select("v", "u")).where("u <> v").distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), "l"), "v").select("u", "l")
        # The node that a label names learns of the labels around those that carry it.
        hooks = near.join(labels.select("u", F.col("l").alias("root")), "u").select(F.col("root").alias("u"), "l")
        best = labels.unionByName(near).unionByName(hooks).groupBy("u").agg(F.min("l").alias("l"))
        jumped = best.alias("x").join(best.alias("y"), F.col("x.l") == F.col("y.u")).select(
            "x.u", F.least("x.l", "y.l").alias("l"))
        new = stored(jumped, "labels")
        moved = new.alias("x").join(labels.alias("y"), "u").where("x.l <> y.l").limit(1).count()
        labels = new
        if moved == 0:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
