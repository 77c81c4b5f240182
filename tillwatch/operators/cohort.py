"""Monthly cohorts within a calendar year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C


def cohort_retention(df: DataFrame) -> DataFrame:
    """Long form, all years at once: customers of a first month that buy again k months later, and their share.

    The first month is the first one *within the year*. Purchases are first reduced to distinct
    (year, customer, month), so a window never sees more than twelve rows per customer.
    """
    months = df.where("is_success AND customer_id IS NOT NULL").select("year", "customer_id", F.trunc("time", "month").alias("month")).distinct()
    first = F.min("month").over(Window.partitionBy("year", "customer_id"))
    k = (F.month("month") - F.month("first_month")).cast("bigint")
    cells = (
        months.withColumn("first_month", first).withColumn("k", k)
        .groupBy("year", "first_month", "k").agg(F.count("*").alias("customers"))
    )
    size = F.max(F.when(F.col("k") == 0, F.col("customers"))).over(Window.partitionBy("year", "first_month"))
    return (
        cells.withColumn("cohort_size", size).withColumn("retention", C.ratio("customers", "cohort_size"))
        .withColumn("first_month", F.date_format("first_month", "yyyy-MM")).orderBy("year", "first_month", "k")
    )


def cohort_matrix(retention: DataFrame) -> DataFrame:
    """Wide form with one column per month offset."""
    return (
        retention.groupBy("year", "first_month", "cohort_size")
        .pivot("k", list(range(12))).agg(F.first("retention"))
        .withColumnsRenamed({str(k): f"m{k}" for k in range(12)}).orderBy("year", "first_month")
    )


def mean_retention(retention: DataFrame) -> DataFrame:
    return retention.groupBy("year", "k").agg(F.avg("retention").alias("mean_retention")).orderBy("year", "k")
