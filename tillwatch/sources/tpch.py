"""Make the five raw ticket-shop tables from order, line-item, part and customer tables.

Every operator works on the ticket schema; this adapter only lets it run on order data. Each order is one payment
attempt; four account holders share one customer key so that some of them never succeed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.schema import CAMPAIGN_TYPES, STATUS_ROWS, STATUS_SCHEMA

ACCOUNTS = 4


def status_table(spark: SparkSession) -> DataFrame:
    """The eight fixed status rows as a literal relation with exact size statistics."""
    def text(v):
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {text(d)}, {text(g)})" for i, d, g in STATUS_ROWS)
    names = ", ".join(f.name for f in STATUS_SCHEMA)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint")


def ticket_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(price).alias("orig"),
        F.sum(price * F.col("l_discount").cast("decimal(4,2)")).alias("disc"),
        F.min("l_partkey").alias("l_partkey"),
    )
    o = _read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    o = o.join(_read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    method = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "money in app")
        .when(F.col("o_orderpriority") == "2-HIGH", "bank account")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "credit card")
        .when(F.col("o_orderpriority") == "5-LOW", "debit card").otherwise("other")
    )
    kind = (  # by discount share: below 3.5 % none, then voucher (2), direct discount (1), reward point (3)
        F.when(F.col("orig").isNull() | (F.col("disc") * 1000 < F.col("orig") * 35), 0)
        .when(F.col("disc") * 1000 < F.col("orig") * 45, 2)
        .when(F.col("disc") * 1000 < F.col("orig") * 55, 1).otherwise(3)
    )
    key = F.col("o_orderkey")
    zero = F.lit(0).cast("decimal(4,2)")
    orig, disc = F.coalesce("orig", zero), F.coalesce("disc", zero)
    return o.select(
        key.cast("string").alias("ticket_id"),
        (F.col("o_custkey") * ACCOUNTS + key % ACCOUNTS).alias("customer_id"),
        method.alias("paying_method"),
        F.col("p_size").cast("double").alias("theater_name"),
        F.concat(F.lit("dev-"), F.col("o_custkey").cast("string")).alias("device_number"),
        orig.cast("double").alias("original_price"),
        disc.cast("double").alias("discount_value"),
        (orig - disc).cast("double").alias("final_price"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(key * 7919) % 86400)).alias("time"),
        F.when(F.col("o_orderstatus") == "P", -(key % 7) - 1).otherwise(1).cast("int").alias("status_id"),
        F.when(kind == 0, 0).otherwise(kind * 100 + _brand_number()).cast("bigint").alias("campaign_id"),
        F.col("p_name").alias("movie_name"),
    )


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "customer").select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(ACCOUNTS - 1)),
                              lambda i: F.col("c_custkey") * ACCOUNTS + i)).alias("customer_id"))
    i = F.col("customer_id")
    born = F.make_date((i % 69 + 1930).cast("int"), (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int"))
    return ids.select(
        "customer_id",
        F.when(i % 9 == 0, "Not verify").when(i % 2 == 1, "Male").otherwise("Female").alias("usergender"),
        F.when(i % 9 == 0, "1970-01-01")  # two text layouts, as delivered by different sign-up forms
        .when(i % 2 == 0, F.date_format(born, "yyyy-MM-dd")).otherwise(F.date_format(born, "M/d/yyyy")).alias("dob"),
    )


def device_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seg = F.col("c_custkey") % 5, F.col("c_mktsegment")
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_number"),
        F.when(k == 0, "iPhone 12").when(k == 1, "browser").when(k == 2, "devicemodel").when(k == 4, "SM-G991").alias("model"),
        F.when(seg.isin("AUTOMOBILE", "BUILDING", "FURNITURE"), "mobile").when(seg == "MACHINERY", "website").alias("platform"),
    )


def campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(t).alias("campaign_type"))
                      for n, t in enumerate(CAMPAIGN_TYPES, 1)])
    return (
        _read(spark, sf_dir, "part").select(_brand_number().alias("b")).distinct()
        .select("b", F.inline(kinds)).select((F.col("n") * 100 + F.col("b")).alias("campaign_id"), "campaign_type")
    )


def raw_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "ticket_history": ticket_history(spark, sf_dir),
        "customer": customer(spark, sf_dir),
        "campaign": campaign(spark, sf_dir),
        "device_detail": device_detail(spark, sf_dir),
        "status_detail": status_table(spark),
    }


def event_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase and error events as payment attempts with microsecond times."""
    return as_attempts(_read(spark, sf_dir, "events"))


def as_attempts(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type").isin("purchase", "error"))
    ok = F.col("event_type") == "purchase"
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").cast("string").alias("ticket_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("time"),
        F.col("value").alias("final_price"),
        F.when(ok, 1).otherwise(-1 - k % 7).cast("int").alias("status_id"),
    )
