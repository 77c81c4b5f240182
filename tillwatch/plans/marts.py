"""The four analyst tables, their key check and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.temporal import HOT_ROWS, with_history
from tillwatch.operators import marketing
from tillwatch.operators.clean import clean_customer
from tillwatch.session import write_shared

KEYS = {
    "fact_payment_attempts": ["ticket_id"],
    "dim_customer": ["customer_id"],
    "customer_features": ["customer_id"],
    "campaign_summary": ["campaign_id"],
}
FACT_COLUMNS = [
    "ticket_id", "customer_id", "time", "date", "week", "year_month", "hour", "day_name",
    "paying_method", "platform", "os_version", "device_number", "theater_name", "movie_name",
    "campaign_id", "campaign_type", "is_promotion", "original_price", "discount_value", "final_price",
    "discount_rate", "status_id", "status_description", "error_group", "is_success",
    "attempt_number", "is_first_attempt", "failure_risk_score",
]


def day_after(df: DataFrame) -> Column:
    """Midnight after the last day of data: the default reference time of the marts."""
    return df.select(C.plus_days(F.date_trunc("day", F.max("time")), 1)).scalar()


def fact_payment_attempts(df: DataFrame, scores: DataFrame | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per attempt with its number in the customer's history; ``scores`` (ticket_id, score) adds the risk."""
    out = with_history(df, hot_rows).withColumns({
        "status_description": F.col("description"),
        "date": F.to_date("time"),
        "is_promotion": F.col("type") == "promotion",
        "attempt_number": F.col("n_prev_attempts") + 1,
        "is_first_attempt": F.col("n_prev_attempts") == 0,
        **{c: F.round(c, 2) for c in ("original_price", "discount_value", "final_price")},
        "discount_rate": F.round("discount_rate", 4),
    })
    if scores is not None:
        out = out.join(scores.select("ticket_id", F.round("score", 4).alias("failure_risk_score")), "ticket_id", "left")
    return out.select(*[c for c in FACT_COLUMNS if c in out.columns])


def dim_customer(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Every customer of the customer table, also those without an attempt."""
    ok = F.col("is_success")
    activity = df.groupBy("customer_id").agg(
        F.min("time").alias("first_attempt_time"), F.min(F.when(ok, F.col("time"))).alias("first_success_time"),
        F.count("*").alias("n_attempts"), F.count_if(ok).alias("n_success"),
        C.sum_money("final_price", ok).alias("total_spend"), C.sum_money("discount_value", ok).alias("total_discount"),
        F.min(F.struct("time", "ticket_id", "is_failed")).getField("is_failed").alias("first_attempt_failed"))
    out = clean_customer(customers).join(activity, "customer_id", "left")
    has = F.col("n_attempts").isNotNull()
    out = out.withColumn("has_activity", has).na.fill(0, ["n_attempts", "n_success", "total_spend", "total_discount"])
    last_day = F.to_date(C.scalar_max(df))
    return out.withColumns({
        "age": C.age_at("dob", last_day),
        "age_generation": C.generation("dob"),
        "n_failed": F.col("n_attempts") - F.col("n_success"),
        "success_rate": C.ratio("n_success", "n_attempts"),
        "lost_at_first_payment": C.is_true(F.col("first_attempt_failed")) & F.col("first_success_time").isNull(),
        "is_verified_profile": (F.col("usergender") != "Not verify") & C.is_true(F.year("dob") != 1970),
    })


def lost_by_generation(dim: DataFrame) -> DataFrame:
    return dim.where("has_activity AND is_verified_profile").groupBy("age_generation").agg(
        F.count("*").alias("customers"), C.rate("lost_at_first_payment").alias("lost_rate")).orderBy(
        F.desc("lost_rate"), "age_generation")


def customer_features(df: DataFrame, as_of: Column, scored: DataFrame | None = None) -> DataFrame:
    """RFM features with segment and action at ``as_of``; ``scored`` (customer_id, score, score_source) adds the
    repurchase score, otherwise the recency rule is used."""
    out = marketing.with_segment(marketing.customer_features(df, as_of))
    if scored is None:
        out = out.withColumn("score", marketing.recency_score()).withColumn("score_source", F.lit("rule: recency"))
    else:
        out = out.join(scored.select("customer_id", "score", "score_source"), "customer_id", "left")
    return out.select(as_of.alias("as_of"), "customer_id", *marketing.FEATURES, "segment", "action",
                      F.round("score", 4).alias("repurchase_score"), "score_source")


def campaign_summary(df: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Volumes, revenue and new-customer return per campaign in the facts; customers are reduced to distinct pairs
    before the campaign step, so a campaign with a third of all rows is spread over tasks."""
    ok = F.col("is_success")
    pairs = df.where(F.col("campaign_id").isNotNull()).groupBy("campaign_id", "customer_id").agg(
        F.count("*").alias("t"), F.count_if(ok).alias("s"), F.count_if("is_failed").alias("f"),
        F.sum(F.when(ok, C.money("final_price"))).alias("r"), F.sum(F.when(ok, C.money("discount_value"))).alias("d"))
    base = pairs.groupBy("campaign_id").agg(
        F.sum("t").alias("tickets"), F.sum("s").alias("success_tickets"), F.count_if((F.col("s") > 0) & F.col("customer_id").isNotNull()).alias("customers"),
        F.sum("r").alias("revenue"), F.sum("d").alias("discount_spend"),
        C.ratio(F.sum("f"), F.sum("t")).alias("failure_rate"))
    money = lambda c: F.coalesce(F.round(c, 2).cast("double"), F.lit(0.0))
    base = base.withColumns({c: money(c) for c in ("revenue", "discount_spend")})
    effect = marketing.campaign_effectiveness(df, "campaign_id", 1).select(
        "campaign_id", "new_customers", "returned_90d", "one_time_rate", "discount_per_returned")
    out = base.join(effect, "campaign_id", "left").join(campaigns, "campaign_id", "left")
    return out.na.fill("none", ["campaign_type"]).orderBy(F.desc("tickets"), "campaign_id")


def key_violations(tables: dict[str, DataFrame], keys: dict[str, list[str]] = KEYS) -> DataFrame:
    """Rows and distinct keys per table; a table passes when both are equal. Keys are counted in two steps."""
    out = None
    for name, df in tables.items():
        per_key = df.groupBy(*keys[name]).agg(F.count("*").alias("n"))
        part = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys")).select(
            F.lit(name).alias("table"), "rows", "keys", (F.col("rows") == F.col("keys")).alias("unique"))
        out = part if out is None else out.unionByName(part)
    return out


def export(tables: dict[str, DataFrame], out_dir: str, keys: dict[str, list[str]] = KEYS) -> None:
    """Compute every table once into the shared folder, check all keys, and only then publish Parquet and CSV."""
    staged = {name: write_shared(df, name) for name, df in tables.items()}
    bad = key_violations(staged, keys).where("NOT unique").select("table").collect()  # one row per table
    if bad:
        raise ValueError(f"key is not unique: {[(r['table'], keys[r['table']]) for r in bad]}")
    for name, df in staged.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(f"{path}.parquet")
        df.write.mode("overwrite").option("header", True).csv(f"{path}.csv")
