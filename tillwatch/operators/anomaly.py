"""Weekly alerts: error rates that rise against the median of the preceding periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.temporal import array_mad, array_median, week_spine
from tillwatch.schema import ERROR_GROUPS

WINDOW, Z_THRESHOLD, MIN_TICKETS = 8, 3.0, 100
MIN_SPREAD = 0.003  # keeps z finite when the preceding periods are all alike
MAD_SCALE = 1.4826


def detect(rates: DataFrame, period: str = "week", z_threshold: float = Z_THRESHOLD, min_tickets: int = MIN_TICKETS,
           window: int = WINDOW) -> DataFrame:
    """Long table period x error group with baseline, robust z and alert flag.

    Periods with too few attempts are removed first, so the baseline is made of ``window`` *eligible* periods. The
    input has one row per period; the frame arrays hold ``window`` numbers.
    """
    groups = F.array(*[
        F.struct(F.lit(g).alias("error_group"), F.col(g).cast("double").alias("n_errors"), F.col(f"{g}_rate").alias("rate"))
        for g in ERROR_GROUPS
    ])
    long = rates.where(F.col("n_tickets") >= min_tickets).select(period, "n_tickets", F.inline(groups))
    w = Window.partitionBy("error_group").orderBy(period).rowsBetween(-window, -1)
    past = long.withColumn("_past", F.collect_list("rate").over(w))
    enough = F.size("_past") >= window - 2
    out = past.withColumn("baseline", F.when(enough, array_median(F.col("_past"))))
    spread = F.greatest(F.lit(MAD_SCALE) * array_mad(F.col("_past"), F.col("baseline")), F.lit(MIN_SPREAD))
    rise = F.col("rate") - F.col("baseline")
    out = out.withColumn("z", F.when(enough, rise / spread))
    return out.select(
        period, "error_group", "n_tickets", "n_errors", "rate", "baseline", "z",
        F.coalesce(F.col("z") >= z_threshold, F.lit(False)).alias("is_alert"),
        F.when(rise.isNotNull(), F.greatest(rise * F.col("n_tickets"), F.lit(0.0))).alias("excess_errors"),
    ).orderBy(period, "error_group")


def alerts_in(alerts: DataFrame, year: int | Column | None = None, period: str = "week") -> DataFrame:
    hits = alerts.where("is_alert")
    return hits if year is None else hits.where(F.year(period) == year)


def recent_calendar(alerts: DataFrame, group: str = "external", weeks: int = 26) -> DataFrame:
    """The last calendar weeks of one error group; weeks without an eligible row stay as gaps."""
    spine = week_spine(alerts, last=weeks)
    return spine.join(alerts.where(F.col("error_group") == group).drop("error_group"), "week", "left").orderBy("week")
