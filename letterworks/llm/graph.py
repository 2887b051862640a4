"""Connected components of an undirected graph, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterworks.session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (src, dst); the root is the smallest node of the component.

    Each round takes the smallest label among a node and its neighbours and then
    the label of that label, so paths shorten by half. Labels are written between
    rounds, which cuts the lineage; only a flag reaches the driver.
    """
    both = stage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "component-edges")
    labels = stage(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("root")), "component-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("root").alias("low"))
        lower = labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = lower.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root"))
        new = stage(new, "component-labels")
        labels = new.select("node", "root")
        if new.where("was <> root").isEmpty():
            return labels
