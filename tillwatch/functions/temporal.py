"""Ordered per-customer operators that stay balanced when one customer owns most of the rows.

A window partitioned by customer puts every row of a customer into one task. Customers above ``hot_rows``
rows are therefore cut into hourly segments: the window runs per (customer, segment), one small row per segment
carries what the neighbouring segments need, and the two are put together. Other customers form one segment.
Counting rows per customer is combined map-side, so finding the hot ones does not move the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions.tables import keyed

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000
_SEG = "_segment"


def with_segments(df: DataFrame, hot_rows: int = HOT_ROWS, key: str = "customer_id", time: str = "time",
                  grain: str = "hour") -> DataFrame:
    """Add ``_segment`` (null for ordinary keys, the truncated time for hot ones) and partition by (key, segment).

    A key is hot above ``hot_rows`` rows and above 1/100,000 of all rows, so fewer than 100,000 keys can be hot and
    their list is safe to broadcast at any data size. The explicit repartition is the shuffle the window needs; left to
    itself Spark would keep an earlier partitioning by key alone and put a hot key back into one task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    limit = counts.agg(F.greatest(F.lit(float(hot_rows)), F.sum("_n") / MAX_HOT_KEYS)).scalar()
    hot = counts.where(F.col("_n") > limit).select(key, F.lit(True).alias("_hot"))
    d = df.join(F.broadcast(hot), key, "left")
    split = F.coalesce("_hot", F.lit(False)) | F.col(key).isNull()  # rows without a key belong to no group and are only spread
    return d.withColumn(_SEG, F.when(split, F.date_trunc(grain, time))).drop("_hot").repartition(key, _SEG)


def with_next_success(df: DataFrame, strict: bool, name: str = "next_success", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Forward as-of match: the time of the same customer's next success.

    ``strict=False`` accepts a success at the very same time, ``strict=True`` only a later one. One shuffle and
    one sort, no self-join: a growing range frame over the negated time sees exactly the rows that follow. Rows without a
    customer match nothing.
    """
    d = with_segments(df, hot_rows)
    success_time = F.when(F.col("is_success") & F.col("customer_id").isNotNull(), F.col("time"))
    w = (
        Window.partitionBy("customer_id", _SEG).orderBy(-F.unix_micros("time"))
        .rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    )
    inside = d.withColumn("_inside", F.min(success_time).over(w))
    later = Window.partitionBy("customer_id").orderBy(F.desc(_SEG)).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        d.where(F.col(_SEG).isNotNull())
        .groupBy("customer_id", _SEG).agg(F.min(success_time).alias("_first"))
        .withColumn("_later", F.min("_first").over(later)).drop("_first")
    )
    return (
        inside.join(carry, ["customer_id", _SEG], "left")
        .withColumn(name, F.coalesce("_inside", "_later")).drop("_inside", "_later", _SEG)
    )


def with_history(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Point-in-time history of the same customer, the current row excluded.

    Adds ``n_prev_attempts``, ``n_prev_failed``, ``prev_failed`` (boolean) and ``prev_time``; rows are ordered by
    (time, ticket_id). Rows without a customer have no history.
    """
    d = with_segments(df, hot_rows)
    named = F.col("customer_id").isNotNull()
    order = ["time", "ticket_id"]
    w = Window.partitionBy("customer_id", _SEG).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    failed = F.col("is_failed").cast("bigint")
    rows = (
        d.withColumn("_n", F.row_number().over(w).cast("bigint") - 1)
        .withColumn("_f", F.coalesce(F.sum(failed).over(before), F.lit(0).cast("bigint")))
        .withColumn("_pf", F.lag("is_failed").over(w))
        .withColumn("_pt", F.lag("time").over(w))
    )
    segs = Window.partitionBy("customer_id").orderBy(_SEG)
    earlier = segs.rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        d.where(F.col(_SEG).isNotNull()).groupBy("customer_id", _SEG)
        .agg(F.count("*").alias("_sn"), F.sum(failed).alias("_sf"),
             F.max(F.struct(*order, "is_failed")).alias("_last"))
        .select("customer_id", _SEG,
                F.sum("_sn").over(earlier).alias("_bn"), F.sum("_sf").over(earlier).alias("_bf"),
                F.lag("_last").over(segs).alias("_bl"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        rows.join(carry, ["customer_id", _SEG], "left")
        .withColumn("n_prev_attempts", F.when(named, F.col("_n") + F.coalesce("_bn", zero)).otherwise(zero))
        .withColumn("n_prev_failed", F.when(named, F.col("_f") + F.coalesce("_bf", zero)).otherwise(zero))
        .withColumn("prev_failed", F.when(named, F.coalesce("_pf", F.col("_bl.is_failed"))))
        .withColumn("prev_time", F.when(named, F.coalesce("_pt", F.col("_bl.time"))))
        .drop("_n", "_f", "_pf", "_pt", "_bn", "_bf", "_bl", _SEG)
    )


def first_two(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """First row per key with ``second_time``, ordered by (time, ticket_id).

    ``row_number() <= 2`` lets Spark prune every key to two rows before the shuffle, so a hot key costs nothing.
    """
    w = Window.partitionBy(key).orderBy("time", "ticket_id")
    top = keyed(df, key).select(key, "time", "ticket_id", *cols).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    first = [F.max(F.when(F.col("_rn") == 1, F.col(c))).alias(c) for c in ["time", "ticket_id", *cols]]
    return top.groupBy(key).agg(*first, F.max(F.when(F.col("_rn") == 2, F.col("time"))).alias("second_time"))


def month_spine(df: DataFrame, time: str = "time") -> DataFrame:
    """Every month between the first and the last row, also those without rows."""
    ends = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    months = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("interval 1 month"))
    return ends.select(F.explode(months).alias("month")).select(F.date_format("month", "yyyy-MM").alias("year_month"))


def week_spine(df: DataFrame, week: str = "week", last: int | None = None) -> DataFrame:
    """Every Monday between the first and last week; ``last`` keeps only the newest ones."""
    ends = df.agg(F.min(week).alias("a"), F.max(week).alias("b"))
    weeks = F.sequence(F.col("a").cast("date"), F.col("b").cast("date"), F.expr("interval 7 days"))
    if last:
        weeks = F.slice(F.reverse(weeks), 1, last)
    return ends.select(F.explode(weeks).alias("_day")).select(F.col("_day").cast("timestamp").alias(week))


def array_median(a: Column) -> Column:
    """Exact, linearly interpolated median of an array of doubles; null for an empty one."""
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return F.when(n > 0, (F.try_element_at(s, lo) + F.try_element_at(s, hi)) / 2)


def array_mad(a: Column, median: Column) -> Column:
    return array_median(F.transform(a, lambda x: F.abs(x - median)))
