"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of the edges (a, b) can reach.

    Every round takes the smallest root among the neighbours, then the root's root, so paths
    shorten by half; minima are combined before the shuffle, so a hub is one row per task.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = materialize(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hopped = labels.join(near, "node").select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root")
        )
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        following = materialize(
            hopped.join(roots, "root").select("node", "old", F.least("root", "above").alias("root")),
            "labels",
        )
        labels = following.select("node", "root")
        if following.where(F.col("root") != F.col("old")).isEmpty():
            return labels
