"""Cleaning and the star join: one row per payment attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.functions import columns as C


def clean_customer(customer: DataFrame) -> DataFrame:
    return customer.withColumn("dob", C.parse_date("dob"))


def clean_device(device: DataFrame) -> DataFrame:
    """Unknown models are named; rows without the join key are dropped."""
    return device.na.fill("Unknown", ["model"]).na.drop(subset=["device_number"])


def clean_tickets(tickets: DataFrame) -> DataFrame:
    """Typed time, exact duplicate rows removed."""
    if dict(tickets.dtypes)["time"] == "string":
        tickets = tickets.withColumn("time", C.parse_time("time"))
    return tickets.dropDuplicates()


def calendar_columns(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({
        "year": F.year(time),
        "year_month": C.year_month(time),
        "week": C.week_start(time),
        "hour": F.hour(time),
        "day_name": F.date_format(time, "EEEE"),
    })


def with_status(df: DataFrame, status: DataFrame) -> DataFrame:
    return df.join(status, "status_id", "left").withColumns({
        "is_success": F.col("status_id") == 1,
        "is_failed": ~C.is_true(F.col("status_id") == 1),
        "error_group": F.coalesce("error_group", F.lit("none")),
    }).withColumn("is_success", C.is_true(F.col("is_success")))


def clean_and_join(raw: dict[str, DataFrame], as_of: Column | None = None) -> DataFrame:
    """The cleaned fact table.

    Join strategies are left to Spark: the status table is a sized literal, campaign and device are broadcast only
    if their measured size allows it, and a hot customer in the big join is split by adaptive skew handling.
    ``as_of`` is the date ages refer to; by default the last day in the data.
    """
    tickets = raw["ticket_history"]
    reference = as_of if as_of is not None else F.to_date(C.scalar_max(_typed_time(tickets)))
    df = (
        clean_tickets(tickets)
        .join(clean_customer(raw["customer"]), "customer_id", "left")
        .join(raw["campaign"], "campaign_id", "left")
        .join(clean_device(raw["device_detail"]), "device_number", "left")
    )
    df = with_status(df, raw["status_detail"])
    df = df.na.fill("none", ["campaign_type"]).na.fill("Unknown", ["model", "platform"])
    return calendar_columns(df.withColumns({
        "type": F.when(F.col("campaign_type") == "none", "non-promotion").otherwise("promotion"),
        "os_version": C.device_class("model"),
        "age": C.age_at("dob", reference),
        "age_generation": C.generation("dob"),
        "discount_rate": C.ratio("discount_value", "original_price"),
    }))


def _typed_time(tickets: DataFrame) -> DataFrame:
    t = tickets.select("time")
    return t.select(C.parse_time("time").alias("time")) if dict(t.dtypes)["time"] == "string" else t


def before(df: DataFrame, cut: Column, time: str = "time") -> DataFrame:
    """No look-ahead: only rows strictly before the cut."""
    return df.where(F.col(time) < cut)


def between(df: DataFrame, start: Column | None = None, end: Column | None = None, time: str = "time") -> DataFrame:
    if start is not None:
        df = df.where(F.col(time) >= start)
    return df if end is None else df.where(F.col(time) < end)
