"""Point-in-time features and labels for the failure model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.temporal import HOT_ROWS, first_two, with_history, with_next_success

CATEGORICAL = ["paying_method", "platform", "os_version", "campaign_type", "usergender"]
NUMERIC = [
    "hour", "dow", "original_price", "discount_rate", "birth_year", "n_prev_attempts", "n_prev_failed",
    "n_prev_success", "last_attempt_failed", "minutes_since_prev",
]


def build_features(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Only what was known at the time of the attempt; the row itself never counts in its own history."""
    d = with_history(df.select(
        "ticket_id", "customer_id", "time", "is_failed", "status_id", *CATEGORICAL, "hour", "original_price",
        "discount_rate", "dob"), hot_rows)
    minutes = C.elapsed_us("prev_time", "time") / F.lit(60_000_000)
    return d.select(
        "ticket_id", "customer_id", "time", "status_id", *[F.coalesce(c, F.lit("unknown")).alias(c) for c in CATEGORICAL],
        F.col("hour").cast("bigint").alias("hour"), F.weekday("time").cast("bigint").alias("dow"), "original_price",
        "discount_rate", F.year("dob").cast("bigint").alias("birth_year"), "n_prev_attempts", "n_prev_failed",
        (F.col("n_prev_attempts") - F.col("n_prev_failed")).alias("n_prev_success"),
        F.coalesce(F.col("prev_failed").cast("bigint"), F.lit(0)).cast("bigint").alias("last_attempt_failed"),
        F.coalesce(minutes, F.lit(-1.0)).alias("minutes_since_prev"),
        F.col("is_failed").cast("bigint").alias("is_failed"),
    )


def time_split(features: DataFrame, start: Column) -> tuple[DataFrame, DataFrame]:
    return features.where(F.col("time") < start), features.where(F.col("time") >= start)


def rule_scores(train: DataFrame, test: DataFrame, column: str = "paying_method", target: str = "is_failed") -> DataFrame:
    """One-variable rule: the training rate of the row's category, the overall rate for unseen ones."""
    rate = train.groupBy(column).agg(F.avg(target).alias("score"))
    overall = train.agg(F.avg(target)).scalar()
    return test.join(rate, column, "left").withColumn("score", F.coalesce("score", overall))


def repeat_labels(df: DataFrame, until: Column | None = None) -> DataFrame:
    """First purchases with a flag for a second one within 90 days; ``until`` keeps fully observed ones."""
    first = first_two(df.where("is_success"), "customer_id", ["year"])
    if until is not None:
        first = first.where(F.col("time") < until)
    back = C.is_true(C.whole_days("time", "second_time") <= 90)
    return first.select("customer_id", "ticket_id", "time", "year", back.cast("bigint").alias("repeat_90d"))


def recovery_labels(df: DataFrame, until: Column | None = None, days: int = 7, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Failures with a flag for a purchase by the same customer within ``days``."""
    d = with_next_success(df.select("ticket_id", "customer_id", "time", "year", "is_success", "is_failed"),
                          strict=False, hot_rows=hot_rows).where("is_failed")
    if until is not None:
        d = d.where(F.col("time") < until)
    back = C.is_true(C.within_days("time", "next_success", days))
    return d.select("ticket_id", "customer_id", "time", "year", back.cast("bigint").alias(f"recovered_{days}d"))
