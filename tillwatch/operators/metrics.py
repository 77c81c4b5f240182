"""Payment failure, first-attempt and recovery metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.tables import keyed
from tillwatch.functions.temporal import HOT_ROWS, with_next_success
from tillwatch.schema import ERROR_GROUPS

FIRST_COLUMNS = ["is_failed", "final_price", "description", "error_group", "paying_method", "year", "week"]


def first_attempts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per customer: the first attempt, whether the customer ever paid, and how long that took.

    The minimum of a struct is combined map-side, so a customer with very many rows sends one row per task.
    """
    columns = FIRST_COLUMNS if columns is None else columns
    per_customer = keyed(df, "customer_id").groupBy("customer_id").agg(
        F.min(F.struct("time", "ticket_id", *columns)).alias("_first"),
        F.min(F.when(F.col("is_success"), F.col("time"))).alias("first_success_time"),
        F.count_if("is_success").alias("n_success"),
        F.sum(F.when(F.col("is_success"), C.money("final_price"))).alias("success_value"),
    )
    hours = C.elapsed_us("time", "first_success_time") / F.lit(3_600_000_000)
    return (
        per_customer.select("customer_id", "_first.*", "first_success_time", "n_success", "success_value")
        .withColumnRenamed("is_failed", "first_failed")
        .withColumn("ever_converted", F.col("first_success_time").isNotNull())
        .withColumn("hours_to_convert", F.when(F.col("first_failed"), hours))
    )


def lost_at_payment_summary(df: DataFrame) -> DataFrame:
    """Customers whose first payment failed and who never came back to buy: nine numbers in one row."""
    first = first_attempts(df, ["is_failed", "final_price"])
    failed = F.col("first_failed")
    lost = failed & ~F.col("ever_converted")
    agg = first.agg(
        F.count("*").alias("customers_total"),
        F.count_if(failed).alias("failed_first_attempt"),
        F.count_if(lost).alias("never_converted"),
        F.count_if(failed & (F.col("hours_to_convert") <= 1)).alias("recovered_within_1h"),
        F.count_if(failed & (F.col("hours_to_convert") <= 24)).alias("recovered_within_24h"),
        C.sum_money("final_price", lost).alias("lost_first_order_value"),
        F.sum("success_value").cast("double").alias("_value"),
        F.sum("n_success").alias("_n"),
    )
    return agg.select(
        "customers_total", "failed_first_attempt",
        C.ratio("failed_first_attempt", "customers_total").alias("failed_first_attempt_pct"),
        "never_converted",
        C.ratio("never_converted", "failed_first_attempt").alias("never_converted_pct_of_failed"),
        "recovered_within_1h", "recovered_within_24h", "lost_first_order_value",
        C.ratio("_value", "_n").alias("avg_success_ticket_value"),
    )


def lost_customers(df: DataFrame) -> DataFrame:
    first = first_attempts(df)
    return first.where(F.col("first_failed") & ~F.col("ever_converted"))


def lost_by_reason(df: DataFrame, label_length: int = 32) -> DataFrame:
    """Lost customers by error text, method, year and error group, with shares; one aggregation for all four."""
    lost = lost_customers(df)
    views = F.array(*[
        F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
        for name, value in [
            ("description", F.col("description")), ("paying_method", F.col("paying_method")),
            ("year", F.col("year")), ("error_group", F.col("error_group"))]
    ])
    counts = (
        lost.select(F.inline(views)).where(F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.count("*").alias("customers"))
    )
    out = with_share(counts, "customers", ["dimension"])
    short = F.when(F.col("dimension") == "description", F.substring("value", 1, label_length)).otherwise(F.col("value"))
    return out.withColumn("value", short)


def with_share(counts: DataFrame, n: str, by: list[str], name: str = "share") -> DataFrame:
    """Share of the group's total, over already counted rows."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    return counts.withColumn(name, C.ratio(n, F.sum(n).over(w)))


def rescue_scenarios(df: DataFrame, rates: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """What winning back a share of the lost customers would bring."""
    s = lost_at_payment_summary(df)
    return s.select(
        F.explode(F.array(*[F.lit(r) for r in rates])).alias("rescue_rate"), "never_converted", "lost_first_order_value",
    ).select(
        "rescue_rate",
        F.rint(F.col("rescue_rate") * F.col("never_converted")).cast("bigint").alias("customers_rescued"),
        F.rint(F.col("rescue_rate") * F.col("lost_first_order_value")).alias("value_rescued"),
    )


def followup_rates(df: DataFrame) -> DataFrame:
    """Purchase after a failed first attempt, and a further purchase after a good one."""
    first = first_attempts(df, ["is_failed"])
    return first.agg(
        C.rate(F.when(F.col("first_failed"), F.col("ever_converted"))).alias("bought_after_failed_first"),
        C.rate(F.when(~F.col("first_failed"), F.col("n_success") > 1)).alias("bought_again_after_ok_first"),
    )


def failure_rate_by(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count("ticket_id").alias("n_tickets"), F.count_if("is_failed").alias("n_failed"))
        .withColumn("failure_rate", C.ratio("n_failed", "n_tickets"))
        .orderBy(F.desc("failure_rate"), column)
    )


def weekly_error_rates(df: DataFrame, period: str = "week") -> DataFrame:
    """Attempts, errors and error rates per period and error group; periods without errors stay."""
    failed = F.col("is_failed")
    out = df.where(F.col(period).isNotNull()).groupBy(period).agg(
        F.count("*").alias("n_tickets"),
        *[F.count_if(failed & (F.col("error_group") == g)).alias(g) for g in ERROR_GROUPS],
    )
    total = sum((F.col(g) for g in ERROR_GROUPS[1:]), F.col(ERROR_GROUPS[0]))
    return out.select(
        "*", *[C.ratio(g, "n_tickets").alias(f"{g}_rate") for g in ERROR_GROUPS],
        C.ratio(total, "n_tickets").alias("failure_rate"),
    )


def recovery_rate(df: DataFrame, days: int = 7, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Share of failures that the same customer paid within ``days``; the last ``days`` of data are left out."""
    end = C.scalar_max(df)
    rows = with_next_success(df.select("customer_id", "time", "is_success", "is_failed"), strict=False, hot_rows=hot_rows)
    rows = rows.where(F.col("is_failed") & (F.col("time") <= C.plus_days(end, -days)))
    return rows.agg(
        F.count("*").alias("failures"),
        C.rate(C.is_true(C.within_days("time", "next_success", days))).alias("recovery_rate"),
    )


def next_success_gaps(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every attempt with the time of the next later success and the gap in days."""
    rows = with_next_success(df.select("ticket_id", "customer_id", "time", "is_success"), strict=True, hot_rows=hot_rows)
    return rows.select("ticket_id", "customer_id", "time", "next_success",
                       (C.elapsed_us("time", "next_success") / F.lit(C.DAY_US)).alias("gap_days"))


def monthly_success_rate(df: DataFrame) -> DataFrame:
    return df.groupBy("year_month").agg(
        F.count("*").alias("tickets"), F.count_if("is_success").alias("success"),
        C.rate("is_success").alias("success_rate")).orderBy("year_month")


def monthly_group_rate(df: DataFrame, group: str = "external", year: int | None = None) -> DataFrame:
    """Share of all attempts of a month that belong to one error group."""
    d = df if year is None else df.where(F.col("year") == year)
    return d.groupBy("year_month").agg(
        F.count("*").alias("tickets"), C.rate(F.col("error_group") == group).alias(f"{group}_rate")).orderBy("year_month")


def error_trend(df: DataFrame, column: str = "error_group") -> DataFrame:
    return (
        df.where(F.col("is_failed") & F.col(column).isNotNull()).groupBy("year_month", column)
        .agg(F.count("ticket_id").alias("n_ords")).orderBy("year_month", column)
    )


def errors_by_code(df: DataFrame, week: Column) -> DataFrame:
    return (
        df.where((F.col("week") == week) & F.col("is_failed") & F.col("description").isNotNull())
        .groupBy("description").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "description")
    )
