"""Table-level helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def keyed(df: DataFrame, *keys: str) -> DataFrame:
    """Rows with all keys present: rows without a key belong to no group."""
    return df.na.drop(subset=list(keys))


def union_on(parts: list[DataFrame], *keys: str) -> DataFrame:
    """Union of tables that are grouped or joined on ``keys`` afterwards.

    Spark 4.1 lets a union inherit the common partitioning of its inputs, but adaptive execution may coalesce each input
    differently, so equal keys can end up in different partitions and be counted twice. The explicit repartition is the
    shuffle the next step would need anyway and does not rely on that inheritance.
    """
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).repartition(*keys)
