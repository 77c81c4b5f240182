"""Base tables from CSV files, and the cleaned fact from history or from the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.functions import columns as C
from tillwatch.operators.clean import clean_and_join
from tillwatch.schema import SCHEMAS, TICKETS


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """One CSV table: columns found by their header names, read as text and cast to the table's types."""
    text = spark.read.option("header", True).option("escape", '"').csv(f"{data_dir.rstrip('/')}/{name}.csv")
    cast = {T.LongType: C.parse_whole, T.IntegerType: lambda c: C.parse_whole(c).try_cast("int"), T.DoubleType: C.parse_number,
            T.TimestampType: C.parse_time, T.StringType: F.col}
    return text.select(*[cast[type(f.dataType)](f.name).alias(f.name) for f in SCHEMAS[name]])


def load_raw(spark: SparkSession, data_dir: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, data_dir, name) for name in SCHEMAS}


def load_tickets(spark: SparkSession, data_dir: str, warehouse=None) -> DataFrame:
    """The cleaned fact from the history file, or from the loaded warehouse (``plans.load.Paths``) with the current
    reference tables. Nothing is computed here; store the result with ``session.write_shared`` to reuse it."""
    raw = load_raw(spark, data_dir)
    if warehouse is not None:
        from tillwatch.plans import load
        refs = {k: v for k, v in raw.items() if k != TICKETS}
        raw = {TICKETS: load.read_warehouse(spark, warehouse).select(*SCHEMAS[TICKETS].names), **load.load_refs(spark, warehouse, refs)}
    return clean_and_join(raw)
