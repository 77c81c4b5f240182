"""The two fact tables the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwatch.operators import clean
from tillwatch.session import write_shared
from tillwatch.sources import tpch

_stored: dict[tuple[str, str], DataFrame] = {}


def _session_key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned fact; the stored copy when ``store_tickets`` has written one in this application."""
    stored = _stored.get(_session_key(spark, sf_dir))
    return stored if stored is not None else clean.clean_and_join(tpch.raw_tables(spark, sf_dir))


def store_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the fact once for a job that makes many reports, one folder per year so that cuts prune files."""
    df = clean.clean_and_join(tpch.raw_tables(spark, sf_dir))
    # rows of one year are spread over tasks by customer, so no year or hot customer decides a task's size alone
    stored = write_shared(df, "tickets", ["year"])
    _stored[_session_key(spark, sf_dir)] = stored
    return stored


def kept_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned fact, written once for a query that reads it many times."""
    df = tickets(spark, sf_dir)
    return df if _session_key(spark, sf_dir) in _stored else write_shared(df, "tickets")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.with_status(tpch.event_attempts(spark, sf_dir), tpch.status_table(spark))
    return clean.calendar_columns(df)
