"""Column expressions shared by the operators. All of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
DAY_US = 86_400_000_000
STARTS_WITH_YEAR = r"^\d{4}(-|$)"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return col(c).cast(MONEY)


def sum_money(c: str | Column, when: Column | None = None) -> Column:
    """Exact, order-independent sum of a double money column, returned as double."""
    v = money(c)
    return F.sum(v if when is None else F.when(when, v)).cast("double")


def rate(flag: str | Column) -> Column:
    """Share of true rows; null flags are left out."""
    return F.avg(col(flag).cast("double"))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b as double, null when b is 0 or null (ANSI mode would raise)."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def is_true(cond: Column) -> Column:
    """SQL null counts as false, so that ``~is_true(x)`` is true for null."""
    return F.coalesce(cond, F.lit(False))


def elapsed_us(start: str | Column, end: str | Column) -> Column:
    return F.unix_micros(col(end)) - F.unix_micros(col(start))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Elapsed time in complete 24-hour days, rounded down."""
    return F.floor(elapsed_us(start, end) / F.lit(DAY_US)).cast("bigint")


def within_days(start: str | Column, end: str | Column, days: int) -> Column:
    return elapsed_us(start, end) <= F.lit(days * DAY_US)


def plus_days(c: str | Column, days: int) -> Column:
    return col(c) + F.make_dt_interval(F.lit(days))


def year_month(c: str | Column) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def month_end(year_month_col: str | Column) -> Column:
    """Midnight of the last day of a ``yyyy-MM`` month."""
    return F.last_day(F.to_date(F.concat(col(year_month_col), F.lit("-01")))).cast("timestamp")


def week_start(c: str | Column) -> Column:
    """Monday midnight of the week."""
    return F.date_trunc("week", col(c))


def scalar_max(df: DataFrame, c: str = "time") -> Column:
    """max(c) as a scalar subquery: one partial aggregation, one value broadcast by Spark."""
    return df.select(F.max(c)).scalar()


def device_class(model: str | Column) -> Column:
    m = col(model)
    return (
        F.when(m.rlike("iPhone|iPod"), "ios")
        .when(m == "browser", "browser")
        .when(m.rlike("devicemodel|Unknown"), "Unknown")
        .otherwise("android and other")
    )


def age_at(dob: str | Column, reference: str | Column) -> Column:
    """Completed years at the reference date."""
    d, r = col(dob), col(reference)
    not_yet = F.struct(F.month(d), F.dayofmonth(d)) > F.struct(F.month(r), F.dayofmonth(r))
    return F.year(r) - F.year(d) - not_yet.cast("int")


def generation(dob: str | Column) -> Column:
    y = F.year(col(dob))
    return (
        F.when(y < 1965, "baby boomers").when(y < 1981, "gen x").when(y < 1997, "gen y").otherwise("gen z")
    )


def count_bucket(c: str | Column, top: int = 10) -> Column:
    """A count as text, everything from ``top`` on in one open bucket."""
    return F.when(col(c) >= top, F.lit(f"{top}+")).otherwise(col(c).cast("string"))


def parse_date(c: str | Column) -> Column:
    """A date written in one of several layouts; null when none fits."""
    v = F.trim(col(c).cast("string"))
    iso = F.when(v.rlike(STARTS_WITH_YEAR), F.try_to_timestamp(v)).cast("date")
    other = [F.try_to_timestamp(v, F.lit(f)).cast("date") for f in ("M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d MMM yyyy")]
    return F.coalesce(iso, *other)


def parse_time(c: str | Column) -> Column:
    """An ISO-8601 timestamp; null when the text is not one. A time without a date is none: it would mean another day in every run."""
    v = F.trim(col(c).cast("string"))
    return F.when(v.rlike(STARTS_WITH_YEAR), F.try_to_timestamp(v))


def parse_whole(c: str | Column) -> Column:
    """A whole number that may have been written as ``12.0`` or ``1e3``; null for a fraction, which is never cut off, and for what 64 bits do not hold."""
    number = F.trim(col(c).cast("string")).try_cast("decimal(38,18)")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def parse_number(c: str | Column) -> Column:
    return F.trim(col(c).cast("string")).try_cast("double")


def lookup(key: str | Column, table: dict) -> Column:
    """Map a key through a small fixed table; null when absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))
