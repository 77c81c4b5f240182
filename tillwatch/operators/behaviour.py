"""Customer value, promotion use, volumes, shares and movies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.tables import keyed
from tillwatch.functions.temporal import month_spine
from tillwatch.operators.metrics import with_share
from tillwatch.schema import CAMPAIGN_TYPES

PROMO = "promotion"


def customer_value(df: DataFrame) -> DataFrame:
    """Every customer with an attempt, also those who never bought."""
    ok = F.col("is_success")
    return keyed(df, "customer_id").groupBy("customer_id").agg(
        F.count("ticket_id").alias("n_total"), F.count_if(ok).alias("n_success"),
        F.sum(F.when(ok, C.money("original_price")).otherwise(0)).cast("double").alias("s_money"),
        F.sum(F.when(ok, C.money("discount_value")).otherwise(0)).cast("double").alias("s_discount"),
    ).withColumn("success_rate", C.ratio("n_success", "n_total"))


def buyer_value(df: DataFrame) -> DataFrame:
    """Buyers only: active days and months, promotion use and discount share."""
    ok = F.col("is_success")
    day = F.to_date("time")
    # distinct days per customer first, then one row per customer: no unbounded set in one aggregation buffer
    daily = keyed(df, "customer_id").groupBy("customer_id", day.alias("day")).agg(
        F.count("ticket_id").alias("t"), F.count_if(ok).alias("s"), F.count_if(ok & (F.col("type") == PROMO)).alias("p"),
        F.sum(F.when(ok, C.money("original_price"))).alias("m"), F.sum(F.when(ok, C.money("discount_value"))).alias("d"))
    bought = F.col("s") > 0
    return (
        daily.groupBy("customer_id").agg(
            F.sum("s").alias("n_success"), F.sum("m").cast("double").alias("s_money"),
            F.sum("d").cast("double").alias("s_discount"), F.count_if(bought).alias("n_days"),
            F.count_distinct(F.when(bought, C.year_month("day"))).alias("n_months"),
            F.sum("p").alias("n_promotions"), F.sum("t").alias("n_total"))
        .where(F.col("n_success") > 0)
        .withColumn("n_failed", F.col("n_total") - F.col("n_success"))
        .withColumn("success_rate", C.ratio("n_success", "n_total"))
        .withColumn("promotion_value", C.ratio("n_promotions", "n_success"))
        .withColumn("discount_value", C.ratio("s_discount", "s_money"))
    )


def purchase_distribution(df: DataFrame, top: int = 10) -> DataFrame:
    """Number of customers by number of purchases and by number of promotion purchases."""
    ok = F.col("is_success")
    per = keyed(df, "customer_id").groupBy("customer_id").agg(
        F.count_if(ok).alias("purchases"), F.count_if(ok & (F.col("type") == PROMO)).alias("promo_purchases"))
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), C.count_bucket(m, top).alias("bucket"))
                         for m in ("purchases", "promo_purchases")])
    return per.select(F.inline(measures)).groupBy("measure", "bucket").agg(F.count("*").alias("customers"))


def promo_usage(df: DataFrame) -> DataFrame:
    """Promotion share of sales, of buyers, and of promotion buyers with exactly one."""
    ok = F.col("is_success")
    promo = ok & (F.col("type") == PROMO)
    per = keyed(df, "customer_id").groupBy("customer_id").agg(
        F.count_if(ok).alias("s"), F.count_if(promo).alias("p"),
        F.count_if(promo & (F.col("campaign_type") == "direct discount")).alias("d"))
    return per.agg(
        C.ratio(F.sum("p"), F.sum("s")).alias("promo_ticket_share"),
        C.ratio(F.count_if(F.col("p") > 0), F.count_if(F.col("s") > 0)).alias("promo_buyer_share"),
        C.ratio(F.count_if(F.col("p") == 1), F.count_if(F.col("p") > 0)).alias("used_once_share"),
        C.ratio(F.sum("d"), F.sum("p")).alias("direct_discount_share"))


def promo_mix(df: DataFrame) -> DataFrame:
    """Campaign-type mix by how many promotion purchases a customer made."""
    promo = df.where(F.col("is_success") & (F.col("type") == PROMO))
    names = {t: f"n_{t.replace(' ', '_')}" for t in CAMPAIGN_TYPES}
    per = keyed(promo, "customer_id").groupBy("customer_id").agg(
        F.count("ticket_id").alias("n_promotions"),
        *[F.count_if(F.col("campaign_type") == t).alias(n) for t, n in names.items()])
    out = per.groupBy("n_promotions").agg(
        F.count("customer_id").alias("n_cus"), *[F.sum(n).alias(n) for n in names.values()])
    out = out.withColumn("total", sum((F.col(n) for n in list(names.values())[1:]), F.col(list(names.values())[0])))
    return out.select("*", *[C.ratio(n, "total").alias(f"{n}_pct") for n in names.values()]).orderBy("n_promotions")


def promo_vs_organic(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Share of customers with a second purchase, by the kind of their first purchase since a date."""
    ok = df.where("is_success")
    if since is not None:
        ok = ok.where(F.col("time") > since)
    per = keyed(ok, "customer_id").groupBy("customer_id").agg(
        F.min(F.struct("time", "ticket_id", "type")).alias("f"), F.count("*").alias("n"))
    return per.groupBy(F.col("f.type").alias("first_type")).agg(
        F.count("*").alias("customers"), F.count_if(F.col("n") >= 2).alias("returned"),
        C.rate(F.col("n") >= 2).alias("return_rate"))


def volume_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("tickets"))


def volume_by_month(df: DataFrame) -> DataFrame:
    """Months without attempts appear with 0."""
    counts = volume_by(df, "year_month")
    return month_spine(df).join(counts, "year_month", "left").na.fill(0, ["tickets"]).orderBy("year_month")


def volume_by_weekday(df: DataFrame) -> DataFrame:
    return (
        df.groupBy(F.weekday("time").cast("bigint").alias("dow"), "day_name").agg(F.count("*").alias("tickets"))
        .orderBy("dow")
    )


def weekend_ratio(df: DataFrame) -> DataFrame:
    """Mean attempts per day, Saturday and Sunday against Monday to Thursday."""
    daily = df.groupBy(F.to_date("time").alias("day")).agg(F.count("*").alias("n"))
    dow = F.weekday("day")
    return daily.agg(
        F.avg(F.when(dow >= 5, F.col("n"))).alias("weekend_mean"),
        F.avg(F.when(dow <= 3, F.col("n"))).alias("weekday_mean"),
    ).withColumn("ratio", C.ratio("weekend_mean", "weekday_mean"))


def shares(df: DataFrame, *by: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Counts and their share of the total (or of the ``within`` group)."""
    counts = df.groupBy(*within, *by).agg(F.count("*").alias("tickets"))
    for b in by:
        counts = counts.where(F.col(b).isNotNull())
    return with_share(counts, "tickets", list(within))


def month_pivot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Month x category counts; the value list is given, so no extra job looks for it."""
    names = {v: v.lower().replace(" ", "_") for v in values}
    return df.groupBy("year_month").agg(
        *[F.count_if(F.col(column) == v).alias(n) for v, n in names.items()]).orderBy("year_month")


def movie_summary(df: DataFrame, more_than: int = 0) -> DataFrame:
    """Tickets, distinct customers and revenue per movie; distinct pairs are reduced before the per-movie step."""
    pairs = df.where(F.col("is_success") & F.col("movie_name").isNotNull()).groupBy("movie_name", "customer_id").agg(
        F.count("ticket_id").alias("n"), F.sum(C.money("final_price")).alias("v"))
    return (
        pairs.groupBy("movie_name").agg(
            F.sum("n").alias("total_ticket"), F.count("customer_id").alias("total_customer"),
            F.sum("v").cast("double").alias("revenue"))
        .where(F.col("total_ticket") > more_than).orderBy(F.desc("total_ticket"), "movie_name")
    )


def movie_months(df: DataFrame, more_than: int = 1000) -> DataFrame:
    """Monthly tickets of the movies with more than a number of tickets."""
    cells = df.where(F.col("is_success") & F.col("movie_name").isNotNull()).groupBy("movie_name", "year_month").agg(
        F.count("ticket_id").alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy("movie_name"))  # one row per month
    return cells.withColumn("_t", total).where(F.col("_t") > more_than).drop("_t").orderBy("movie_name", "year_month")


def last_periods(df: DataFrame, period: str, n: int) -> DataFrame:
    """The newest ``n`` rows of a table with one row per period."""
    return df.orderBy(F.desc(period)).limit(n)


def heavy_buyers(df: DataFrame, more_than: int = 30) -> DataFrame:
    """Monthly purchases of customers with more than ``more_than`` purchases."""
    cells = keyed(df.where("is_success"), "customer_id").groupBy("customer_id", "year_month").agg(F.count("ticket_id").alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy("customer_id"))  # one row per month
    return cells.withColumn("_t", total).where(F.col("_t") > more_than).drop("_t")


def recovered_vs_never(df: DataFrame) -> DataFrame:
    """Error-group and method mix of failures: customers who never bought beside those who did."""
    failed = F.col("is_failed")
    cells = keyed(df, "customer_id").groupBy("customer_id", "error_group", "paying_method").agg(
        F.count_if(failed).alias("f"), F.count_if("is_success").alias("s"))
    # classes come from one row per customer and code; the class of a customer joins back on the reduced table
    bought = cells.groupBy("customer_id").agg(F.sum("s").alias("bought"))
    j = cells.where(F.col("f") > 0).join(bought, "customer_id")
    dims = F.array(F.struct(F.lit("error_group").alias("dimension"), F.col("error_group").alias("value")),
                   F.struct(F.lit("paying_method").alias("dimension"), F.col("paying_method").alias("value")))
    kind = F.when(F.col("bought") == 0, "never bought").otherwise("recovered").alias("customers")
    counts = (
        j.select(kind, "f", F.inline(dims)).groupBy("customers", "dimension", "value")
        .agg(F.sum("f").alias("failures"))
    )
    return with_share(counts, "failures", ["customers", "dimension"])


def low_success_profile(df: DataFrame) -> DataFrame:
    """Orders, money and promotion use of buyers with at least one failure."""
    ok = F.col("is_success")
    per = keyed(df, "customer_id").groupBy("customer_id").agg(
        F.count("ticket_id").alias("n_orders"), F.count_if(ok).alias("_s"),
        F.sum(C.money("original_price")).cast("double").alias("s_money"),
        F.sum(C.money("discount_value")).cast("double").alias("s_discount"),
        F.count_if(F.col("type") == PROMO).alias("n_promotions"))
    return per.where((F.col("_s") > 0) & (F.col("_s") < F.col("n_orders"))).drop("_s").select(
        "*", C.ratio("n_promotions", "n_orders").alias("promotion_rate"), C.ratio("s_discount", "s_money").alias("discount_rate"))


def low_success_errors(df: DataFrame) -> DataFrame:
    """Monthly error codes of those customers; the semi join keeps failures only."""
    ids = low_success_profile(df).select("customer_id")
    return (
        df.where("is_failed").join(ids, "customer_id", "left_semi")
        .groupBy("year_month", "description").agg(F.count("ticket_id").alias("n_ords"))
    )
