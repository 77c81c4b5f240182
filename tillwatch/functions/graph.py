"""Connected components of a table of links, with joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.session import write_shared

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of ``edges`` (a long, b long): the smallest node that can be reached. Stored.

    Every round hands each node the smallest label among its neighbours and then that label's own label, so long chains halve.
    """
    both = edges.where("a != b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
    both = write_shared(both.select("e.*").distinct(), "neighbours")
    labels = write_shared(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        hop = labels.join(near.toDF("node", "near"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.toDF("label", "further")
        after = write_shared(hop.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")), "labels")
        labels = after.select("node", "label")
        if after.where("was != label").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
