"""Monthly KPI table, month-over-month snapshot and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.temporal import first_two
from tillwatch.schema import KPI_DIRECTIONS

MIN_MONTHLY_TICKETS = 500
BETTER, WORSE = "Tốt hơn", "Xấu hơn"  # fixed values


def monthly_kpis(df: DataFrame) -> DataFrame:
    """One row per month with attempts.

    Attempts are first reduced to (month, customer) with map-side combining, then to months; first purchases are
    reduced to two rows per customer before they are shuffled. Only month-sized tables are joined at the end.
    Values whose 30 or 90 day window is not complete are null.
    """
    end = C.scalar_max(df)
    ok, promo = F.col("is_success"), F.col("type") == "promotion"
    mobile = F.col("platform") == "mobile"
    customer_month = df.groupBy("year_month", "customer_id").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("n_ok"),
        F.count_if(mobile).alias("m"), F.count_if(mobile & ok).alias("m_ok"),
        F.count_if(ok & ~promo).alias("n_ok_plain"),
        F.sum(F.when(ok, C.money("final_price"))).alias("revenue"),
    )
    named = F.col("customer_id").isNotNull()  # attempts without a customer count as attempts only
    months = customer_month.groupBy("year_month").agg(
        F.sum("n").alias("tickets"), F.sum("n_ok").alias("ok"), F.sum("n_ok_plain").alias("ok_plain"),
        F.sum("revenue").cast("decimal(38,4)").alias("revenue"),
        C.rate(F.when(named, F.col("n_ok") > 0)).alias("conversion"),
        C.rate(F.when(named & (F.col("m") > 0), F.col("m_ok") > 0)).alias("mobile_conversion"),
        C.ratio(F.sum("m_ok"), F.sum("m")).alias("app_completion_rate"),
        F.count_if(named & (F.col("n_ok") > 0)).alias("active"),
    )
    first = first_two(df.where(ok), "customer_id", ["year_month", "type", "discount_value"])
    gap = C.whole_days("time", "second_time")
    firsts = first.groupBy("year_month").agg(
        F.count("*").alias("new"),
        F.count_if(promo).alias("new_promo"), F.count_if(~promo).alias("new_plain"),
        C.rate(C.is_true(gap <= 90)).alias("repeat_90d"), C.rate(C.is_true(gap <= 30)).alias("retention_30d"),
        C.sum_money("discount_value", promo).alias("promo_discount"),
        F.count_if(promo & (gap <= 90)).alias("promo_retained"),
    )
    j = months.join(firsts, "year_month", "left")
    closed = lambda days, v: F.when(C.plus_days(C.month_end("year_month"), days) <= end, v)
    to_date = Window.orderBy("year_month")  # month-sized table only
    repeats = F.col("ok") - F.coalesce("new", F.lit(0))
    nullable_ok = F.when(F.col("ok") > 0, F.col("ok"))
    return j.select(
        "year_month", "tickets",
        C.ratio("ok", "tickets").alias("payment_success_rate"),
        (F.lit(1.0) - C.ratio("ok", "tickets")).alias("payment_failure_rate"),
        nullable_ok.alias("success_tickets"), F.col("revenue").cast("double").alias("revenue"), "conversion", "mobile_conversion", "app_completion_rate",
        closed(90, F.col("repeat_90d")).alias("repeat_90d"),
        closed(30, F.col("retention_30d")).alias("retention_30d"),
        C.ratio(F.col("ok_plain") - F.coalesce("new_plain", F.lit(0)), repeats).alias("repeat_no_promo_share"),
        closed(90, C.ratio("promo_discount", "promo_retained")).alias("discount_per_retained"),
        C.ratio(nullable_ok, "active").alias("frequency"),
        C.ratio("revenue", "active").alias("spend_per_customer"),
        C.ratio(F.sum(F.coalesce("revenue", F.lit(0))).over(to_date),
                F.sum(F.coalesce("new", F.lit(0))).over(to_date)).alias("ltv_to_date"),
    ).orderBy("year_month")


def busy_months(kpis: DataFrame, min_tickets: int = MIN_MONTHLY_TICKETS) -> DataFrame:
    return kpis.where(F.col("tickets") >= min_tickets)


def last_finished_month(kpis: DataFrame, week_end: Column) -> DataFrame:
    """The newest listed month that ended before the week did."""
    next_month = F.add_months(F.to_date(F.concat("year_month", F.lit("-01"))), 1).cast("timestamp")
    return kpis.agg(F.max(F.when(next_month <= week_end, F.col("year_month"))).alias("year_month"))


def kpi_changes(kpis: DataFrame) -> DataFrame:
    """Long table month x KPI: value, value of the previous *listed* month, change and verdict."""
    keys = list(KPI_DIRECTIONS)
    long = kpis.select("year_month", *[F.col(k).cast("double").alias(k) for k in keys]).unpivot(
        "year_month", keys, "kpi", "value")
    w = Window.partitionBy("kpi").orderBy("year_month")
    change = F.col("value") - F.col("previous")
    direction = C.lookup("kpi", {k: d for k, (_, _, d) in KPI_DIRECTIONS.items()})
    return (
        long.withColumn("previous", F.lag("value").over(w)).withColumn("change", change)
        .withColumn("kpi_group", C.lookup("kpi", {k: g for k, (g, _, _) in KPI_DIRECTIONS.items()}))
        .withColumn("verdict", F.when(F.col("change").isNull() | (F.col("change") == 0), "")
                    .when(F.col("change") * direction > 0, BETTER).otherwise(WORSE))
        .select("year_month", "kpi_group", "kpi", "value", "previous", "change", "verdict")
    )


def snapshot(kpis: DataFrame, month: str | Column | None = None) -> DataFrame:
    """The KPIs of one month (the newest by default) beside the previous listed month, also as display text."""
    month = C.scalar_max(kpis, "year_month") if month is None else month
    rows = kpi_changes(kpis).where(F.col("year_month") == month)
    return rows.select("year_month", "kpi_group", "kpi", "value", "previous",
                       display("value").alias("value_text"), display("previous").alias("previous_text"))


def display(value: str) -> Column:
    v = F.col(value)
    kind = C.lookup("kpi", {k: f for k, (_, f, _) in KPI_DIRECTIONS.items()})
    text = (
        F.when((kind == "money") & (F.abs(v) < 1000), F.format_number(v, 2))
        .when(kind.isin("money", "int"), F.format_number(v, 0))
        .when(kind == "pct", F.format_string("%.1f%%", v * 100))
        .otherwise(F.format_string("%.2f", v))
    )
    return F.when(v.isNull(), "n/a").otherwise(text)
