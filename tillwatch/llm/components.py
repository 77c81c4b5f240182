"""Connected components of a table of links, by alternating large and small stars; only distributed joins, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.tables import store

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node with the smallest node near it."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))  # a hub's edges are reduced before they travel
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours with the smallest of them; ``a`` is the larger end."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    near = edges.join(low, "a").where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return near.unionByName(low.select("a", F.col("low").alias("b"))).repartition("a", "b").distinct()


def _sign(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a long, b long): the label is the smallest node of its component. Stored."""
    edges = store(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _sign(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        edges = store(_small_star(_large_star(edges)), "links")
        now = _sign(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
