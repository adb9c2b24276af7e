"""Connected components of a link table by distributed minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cutledger.llm import common as cm


def components(links: DataFrame) -> DataFrame:
    """``(node, label)``: the least node reachable from every node of ``links(a, b)``; nulls are not allowed.

    Each round takes the least label among a node and its neighbours, then the label of that label, so
    path lengths fall by more than half a round. Every round is checkpointed.
    """
    edges = cm.saved(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cm.saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "least").alias("new"))
        jump = step.select(F.col("node").alias("root"), F.col("new").alias("further"))
        after = cm.saved(step.join(jump, step["new"] == jump["root"], "left").select(
            "node", F.least("new", F.coalesce("further", "new")).alias("label"), (F.least("new", F.coalesce("further", "new")) < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
