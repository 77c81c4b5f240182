"""Where errors rose: error code x platform x method against the preceding weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C


def latest_full_week(df: DataFrame) -> Column:
    """Monday of the last week whose data reaches its final hour (scalar subquery)."""
    full = F.max("time") >= F.max("week") + F.expr("interval 6 days 23 hours")
    return df.agg(F.when(full, F.max("week")).otherwise(C.plus_days(F.max("week"), -7)).alias("week")).scalar()


def breakdown_changes(df: DataFrame, week: Column, dims: tuple[str, ...] = ("description", "platform", "paying_method"),
                      window: int = 8, min_tickets: int = 30) -> DataFrame:
    """Error rate per combination this week and in the ``window`` weeks before, in one aggregation."""
    segment = list(dims[1:])
    d = df.where((F.col("week") <= week) & (F.col("week") >= C.plus_days(week, -7 * window)))
    for s in segment:
        d = d.where(F.col(s).isNotNull())
    now, failed = F.col("week") == week, F.col("is_failed")
    cells = d.groupBy(*dims).agg(
        F.count_if(now).alias("_n"), F.count_if(now & failed).alias("errors"),
        F.count_if(~now).alias("_pn"), F.count_if(~now & failed).alias("_pe"))
    w = Window.partitionBy(*segment)  # a few cells per segment, already counted
    out = cells.withColumn("attempts", F.sum("_n").over(w)).withColumn("_past", F.sum("_pn").over(w))
    out = out.where((F.col("errors") > 0) & F.col(dims[0]).isNotNull() & (F.col("attempts") >= min_tickets))
    rate, base = C.ratio("errors", "attempts"), F.coalesce(C.ratio("_pe", "_past"), F.lit(0.0))
    return (
        out.select(*dims, "errors", "attempts", rate.alias("rate"), base.alias("baseline_rate"))
        .withColumn("change_pp", (F.col("rate") - F.col("baseline_rate")) * 100)
        .withColumn("excess_errors", F.greatest((F.col("rate") - F.col("baseline_rate")) * F.col("attempts"), F.lit(0.0)))
        .orderBy(F.desc("excess_errors"), *dims)
    )


def top_increases(changes: DataFrame, n: int = 3) -> DataFrame:
    keys = ["description", "platform", "paying_method"]
    return changes.where(F.col("change_pp") > 0).orderBy(F.desc("excess_errors"), *keys).limit(n)
