"""RFM features, segments, 90-day labels and campaign effectiveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.tables import keyed
from tillwatch.functions.temporal import first_two
from tillwatch.schema import SEGMENT_ACTIONS

HORIZON_DAYS = 90
FEATURES = [
    "recency_days", "tenure_days", "frequency", "n_months", "monetary", "avg_price",
    "promo_share", "discount_rate", "wallet_share", "mobile_share", "n_failed",
]
HIGH_VALUE, NEW_ONCE, LAPSED, PROMO, REGULAR = SEGMENT_ACTIONS


def features_at(df: DataFrame, cuts: list[Column], horizon: int | None = None) -> DataFrame:
    """RFM features of every customer who had bought before a cut, for all cuts in one aggregation.

    With ``horizon`` the label ``y`` (a purchase within ``horizon`` days from the cut) comes from the same pass. A row
    is repeated only for the cuts it belongs to and combined map-side to (cut, customer, month) before anything is
    shuffled; no loop, no join with the list of cuts.
    """
    t = F.col("time")
    reach = (lambda c: t < c) if horizon is None else (lambda c: t < C.plus_days(c, horizon))
    names = [f"_cut{i}" for i in range(len(cuts))]
    d = df.select("customer_id", "time", "is_success", "is_failed", "year_month", "final_price", "type", "discount_rate",
                  "paying_method", "platform", *[c.alias(n) for c, n in zip(cuts, names)])
    d = d.withColumn("cut", F.explode(F.array(*[F.when(reach(F.col(n)), F.col(n)) for n in names])))
    d = keyed(d, "cut", "customer_id")
    past = t < F.col("cut")
    ok = past & F.col("is_success")
    share = lambda flag: C.rate(F.when(ok, C.is_true(flag)))
    label = [] if horizon is None else [F.max(F.when(~past & F.col("is_success"), 1).otherwise(0)).alias("y")]
    g = d.groupBy("cut", "customer_id").agg(
        F.max(F.when(ok, t)).alias("_last"), F.min(F.when(ok, t)).alias("_first"),
        F.count_if(ok).alias("frequency"),
        F.count_distinct(F.when(ok, F.col("year_month"))).alias("n_months"),
        F.sum(F.when(ok, C.money("final_price"))).cast("double").alias("monetary"),
        share(F.col("type") == "promotion").alias("promo_share"),
        F.avg(F.when(ok, F.col("discount_rate"))).alias("discount_rate"),
        share(F.col("paying_method") == "money in app").alias("wallet_share"),
        share(F.col("platform") == "mobile").alias("mobile_share"),
        F.count_if(past & F.col("is_failed")).alias("n_failed"),
        *label,
    )
    return g.where(F.col("frequency") > 0).select(
        "cut", "customer_id", C.whole_days("_last", "cut").alias("recency_days"),
        C.whole_days("_first", "cut").alias("tenure_days"), "frequency", "n_months", "monetary",
        C.ratio("monetary", "frequency").alias("avg_price"), "promo_share", "discount_rate", "wallet_share",
        "mobile_share", "n_failed", *(["y"] if horizon is not None else []),
    )


def customer_features(df: DataFrame, cut: Column) -> DataFrame:
    return features_at(df, [cut]).drop("cut")


def training_cuts(cut: Column, n: int = 3, horizon: int = HORIZON_DAYS) -> list[Column]:
    """Monthly cuts whose whole label window lies before ``cut``."""
    last = C.plus_days(cut, -horizon)
    return [last - F.make_ym_interval(months=F.lit(k)) for k in range(n)]


def segment() -> Column:
    """Five segments in order of priority."""
    return (
        F.when((F.col("frequency") >= 3) & (F.col("recency_days") <= 180), HIGH_VALUE)
        .when((F.col("frequency") == 1) & (F.col("recency_days") <= 30), NEW_ONCE)
        .when(F.col("recency_days") > 90, LAPSED)
        .when(F.col("promo_share") >= 0.5, PROMO)
        .otherwise(REGULAR)
    )


def with_segment(features: DataFrame) -> DataFrame:
    return features.withColumn("segment", segment()).withColumn("action", C.lookup("segment", SEGMENT_ACTIONS))


def recency_score() -> Column:
    return F.lit(1.0) / (F.lit(1) + F.col("recency_days"))


def segment_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("segment").agg(
        F.count("*").alias("customers"), F.avg("score").alias("avg_score"),
        C.ratio(F.sum("frequency"), F.count("*")).alias("avg_frequency"),
        C.ratio(F.sum("recency_days"), F.count("*")).alias("avg_recency_days"),
        F.first("action").alias("action"),
    ).orderBy(F.desc("customers"), "segment")


def campaign_effectiveness(df: DataFrame, by: str = "campaign_type", min_customers: int = 100) -> DataFrame:
    """New customers by the campaign of their first purchase, and how many bought again within 90 days.

    Only customers whose 90 days are fully observed count.
    """
    end = C.scalar_max(df)
    first = first_two(df.where("is_success"), "customer_id", [by, "discount_value"])
    seen = first.where((C.plus_days("time", HORIZON_DAYS) <= end) & F.col(by).isNotNull())
    back = C.is_true(C.whole_days("time", "second_time") <= HORIZON_DAYS)
    return (
        seen.groupBy(by).agg(
            F.count("ticket_id").alias("new_customers"), C.rate(back).alias("returned_90d"),
            C.sum_money("discount_value").alias("discount_spend"), F.count_if(back).alias("n_returned"))
        .withColumn("one_time_rate", F.lit(1.0) - F.col("returned_90d"))
        .withColumn("discount_per_returned", C.ratio("discount_spend", "n_returned"))
        .where(F.col("new_customers") >= min_customers)
        .orderBy(F.desc("one_time_rate"), by)
    )


def campaign_verdict(by_type: DataFrame, by_id: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Worst and best promotion type and the number of campaigns that keep almost nobody."""
    promo = by_type.where(F.col("campaign_type") != "none")
    worst = promo.agg(
        F.min_by("campaign_type", F.struct(-F.col("one_time_rate"), "campaign_type")).alias("worst_campaign_type"),
        F.max_by("campaign_type", F.struct(-F.col("one_time_rate"), "campaign_type")).alias("best_campaign_type"))
    n = by_id.agg(F.count_if(F.col("one_time_rate") >= threshold).alias("n")).scalar()
    return worst.withColumn("campaign_ids_one_time", n)
