"""Weekly facts for all weeks at once, and the weekly recovery list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.operators.metrics import first_attempts
from tillwatch.schema import ERROR_GROUPS, RECOVERY_MESSAGES

MIN_METHOD_ATTEMPTS = 30


def weekly_facts(df: DataFrame, alerts: DataFrame, history_weeks: int = 8,
                 min_method: int = MIN_METHOD_ATTEMPTS) -> DataFrame:
    """One typed row per week. Every part is reduced to weeks before it is joined.

    Future rows cannot leak into a week: first attempts and the previous weeks only look back, and whether a new
    customer paid is judged within the same week.
    """
    ok, failed = F.col("is_success"), F.col("is_failed")
    base = df.groupBy("week").agg(
        F.count("*").alias("tickets"), F.count_if(ok).alias("_ok"), C.rate(ok).alias("success_rate"),
        F.count_if(failed).alias("failed_tickets"),
        F.coalesce(C.sum_money("final_price", failed), F.lit(0.0)).alias("failed_ticket_value"),
        C.rate(F.when(ok, F.col("type") == "promotion")).alias("promotion_share_of_success"),
        F.coalesce(C.sum_money("discount_value", ok), F.lit(0.0)).alias("discount_spend"))
    week_number = (F.unix_timestamp("week") / (7 * 86400)).cast("bigint")
    prev = Window.orderBy(week_number).rangeBetween(-history_weeks, -1)  # one row per week
    base = base.withColumn("success_rate_prev", C.ratio(F.sum("_ok").over(prev), F.sum("tickets").over(prev))).drop("_ok")

    errors = df.where(failed & F.col("description").isNotNull()).groupBy("week", "description").agg(F.count("*").alias("n"))
    top_error = errors.groupBy("week").agg(F.min(F.struct((-F.col("n")).alias("f"), "description")).alias("e")).select(
        "week", F.col("e.description").alias("top_error"), (-F.col("e.f")).alias("top_error_count"))

    methods = df.where(F.col("paying_method").isNotNull()).groupBy("week", "paying_method").agg(
        F.count("ticket_id").alias("n"), C.rate(failed).alias("fail"))
    methods = methods.where(F.col("n") >= min_method).groupBy("week").agg(
        F.min(F.struct((-F.col("fail")).alias("f"), "paying_method")).alias("worst"),
        F.max(F.struct((-F.col("fail")).alias("f"), "paying_method")).alias("best"))
    methods = methods.select(
        "week", F.col("worst.paying_method").alias("worst_payment_method"),
        (-F.col("worst.f")).alias("worst_payment_method_failure_rate"),
        F.col("best.paying_method").alias("best_payment_method"),
        (-F.col("best.f")).alias("best_payment_method_failure_rate"))

    first = first_attempts(df, ["is_failed", "week", "final_price"])
    lost = F.col("first_failed") & ~C.is_true(C.week_start("first_success_time") == F.col("week"))
    new = first.groupBy("week").agg(
        F.count("*").alias("new_customers"), F.count_if("first_failed").alias("new_customers_failed_first_payment"),
        F.count_if(lost).alias("new_customers_lost_at_payment"))

    groups = alerts.groupBy("week").agg(*[
        F.max(F.when(F.col("error_group") == g, F.col(c))).alias(f"{g}_{c}")
        for g in ERROR_GROUPS for c in ("rate", "baseline", "z", "is_alert", "excess_errors")])

    out = base
    for part in (top_error, methods, new, groups):
        out = out.join(part, "week", "left")
    zero = ["top_error_count", "new_customers", "new_customers_failed_first_payment", "new_customers_lost_at_payment"]
    return out.na.fill(0, zero).withColumn("week_end", F.date_add("week", 6))


def recovery_list(df: DataFrame, week: Column) -> DataFrame:
    """Customers whose last failure of the week was not followed by a purchase in that week, with the text to send.

    The last failure and the last success per customer are maxima, so this is one map-side combined aggregation.
    """
    last = df.where(F.col("week") == week).groupBy("customer_id").agg(
        F.max(F.when(F.col("is_failed"), F.struct("time", "ticket_id", "paying_method", "status_id", "description"))).alias("f"),
        F.max(F.when(F.col("is_success"), F.col("time"))).alias("_bought"))
    open_ = F.col("f").isNotNull() & ~C.is_true(F.col("_bought") > F.col("f.time"))
    return last.where(open_).select(
        "f.ticket_id", "customer_id", "f.time", "f.paying_method", "f.status_id", "f.description",
        C.lookup("f.status_id", RECOVERY_MESSAGES).alias("message"))
