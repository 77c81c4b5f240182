"""Stored intermediate tables and row identity for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.session import write_shared

def store(df: DataFrame, name: str) -> DataFrame:
    """Write below the shared checkpoint folder and read back: survives lost executors and is computed once.

    The driver's collector is asked to run so that Spark's cleaner drops the shuffle files of the finished jobs; otherwise they
    stay on the executors' disks until the driver happens to collect.
    """
    out = write_shared(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(key_high, key_low): 128 bits of identifier and text, which name a row even where identifiers repeat or are missing; equal rows
    share a key and a result."""
    row = (F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text_col).isNull(), F.col(text_col))
    return [F.xxhash64(F.lit(seed), *row).alias(name) for seed, name in enumerate(("key_high", "key_low"))]
