"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalake.llm.common import stored


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, label for every node of ``edges`` (a, b): the smallest node that it
    reaches. Each round takes the smallest label among a node's neighbours by an
    aggregation with map-side combine, then follows the labels once; rounds
    are written below ``folder`` and so survive lost executors."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{folder}/both")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{folder}/0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        beyond = lower.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        moved = lower.join(beyond, lower["label"] == beyond["via"], "left")
        moved = stored(moved.select("node", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), f"{folder}/{turn}")
        if moved.where("label <> was").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
