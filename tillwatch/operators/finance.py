"""Money lost to failed payments and to one-time promotion customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.temporal import HOT_ROWS, with_next_success

RECOVERY_DAYS = 7
ONE_TIME_DAYS = 90


def monthly_losses(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failed value, the part not bought again within 7 days, promotion discount, and the part that went to
    purchases without another one within 90 days. One as-of pass serves both; months still open are null."""
    end = C.scalar_max(df)
    rows = with_next_success(
        df.select("customer_id", "time", "year_month", "is_success", "is_failed", "type", "final_price", "discount_value"),
        strict=True, hot_rows=hot_rows)
    failed = F.col("is_failed")
    promo = F.col("is_success") & (F.col("type") == "promotion")
    back = lambda days: C.is_true(C.within_days("time", "next_success", days))
    months = rows.where(failed | promo).groupBy("year_month").agg(
        C.sum_money("final_price", failed).alias("failed_value"),
        C.sum_money("final_price", failed & ~back(RECOVERY_DAYS)).alias("unrecovered_failed_value"),
        C.sum_money("discount_value", promo).alias("discount_total"),
        C.sum_money("discount_value", promo & ~back(ONE_TIME_DAYS)).alias("discount_one_time"),
    )
    last_minute = C.month_end("year_month") + F.expr("interval 23 hours 59 minutes")
    closed = lambda days, v: F.when(C.plus_days(last_minute, days) <= end, F.col(v))
    return (
        months.withColumn("unrecovered_failed_value", closed(RECOVERY_DAYS, "unrecovered_failed_value"))
        .withColumn("discount_one_time", closed(ONE_TIME_DAYS, "discount_one_time"))
        .withColumn("unrecovered_share", C.ratio("unrecovered_failed_value", "failed_value"))
        .withColumn("one_time_discount_share", C.ratio("discount_one_time", "discount_total"))
        .orderBy("year_month")
    )


def loss_totals(losses: DataFrame) -> DataFrame:
    """Sums over the months in which every value is known."""
    full = losses.na.drop()
    s = lambda c: C.sum_money(c).alias(c)
    sums = full.agg(F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"),
                    s("failed_value"), s("unrecovered_failed_value"), s("discount_total"), s("discount_one_time"))
    return sums.select(
        "*", C.ratio("unrecovered_failed_value", "failed_value").alias("unrecovered_share"),
        C.ratio("discount_one_time", "discount_total").alias("one_time_discount_share"))


def latest_losses(losses: DataFrame) -> DataFrame:
    """The newest month with a known value, for each of the two losses."""
    newest = lambda v: F.max_by(F.struct("*"), F.when(F.col(v).isNotNull(), F.col("year_month")))
    return losses.agg(newest("unrecovered_failed_value").alias("u"), newest("discount_one_time").alias("d")).select(
        F.col("u.year_month").alias("unrecovered_month"), "u.failed_value", "u.unrecovered_failed_value",
        "u.unrecovered_share", F.col("d.year_month").alias("one_time_discount_month"), "d.discount_total",
        "d.discount_one_time", "d.one_time_discount_share")
