"""Null profile, distinct values, histograms and the data dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.functions import columns as C
from tillwatch.session import write_shared


def null_profile(df: DataFrame) -> DataFrame:
    """Null count and rate per column, one pass over the table."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot("_rows", df.columns, "column", "null_count").select(
        "column", "null_count", C.ratio("null_count", "_rows").alias("null_rate")).orderBy(F.desc("null_rate"), "column")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) with values as text: each distinct value once, counted map-side first."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, n_unique): every distinct value of each column with its count, and how many there are."""
    v = _values(df, columns).where(F.col("value").isNotNull())
    return v.join(v.groupBy("column").agg(F.count("*").alias("n_unique")), "column")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("total")).orderBy(F.desc("total"), column)


def age_histogram(customers: DataFrame, width: int = 5) -> DataFrame:
    """Customers by gender and age bin."""
    low = (F.floor(F.col("age") / width) * width).cast("bigint")
    return customers.where(F.col("age").isNotNull()).groupBy("usergender", low.alias("age_from")).agg(
        F.count("*").alias("customers")).orderBy("usergender", "age_from")


def unverified_profile(customers: DataFrame) -> DataFrame:
    """Gender counts, share born in 1970 among the unverified, share aged 26 to 35 among the verified."""
    unverified = F.col("usergender") == "Not verify"
    return customers.agg(
        F.count("*").alias("customers"), F.count_if(unverified).alias("not_verified"),
        C.rate(F.when(unverified, F.year("dob") == 1970)).alias("not_verified_born_1970"),
        C.rate(F.when(~unverified, F.col("age").between(26, 35))).alias("verified_aged_26_35"))


def top_ages(customers: DataFrame, gender: str = "Not verify", n: int = 5) -> DataFrame:
    """The most frequent ages of one gender value."""
    c = customers.where((F.col("usergender") == gender) & F.col("age").isNotNull())
    return c.groupBy("age").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "age").limit(n)


def describe_by(df: DataFrame, by: str, value: str) -> DataFrame:
    """count, mean, median and maximum per group; the value must be rounded, so the exact median's table of
    distinct values stays small."""
    return df.groupBy(by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.max(value).alias("max")).orderBy(by)


def _type_name(t: T.DataType) -> str:
    return t.simpleString()


def data_dictionary(tables: dict[str, DataFrame], descriptions: dict[str, str] | None = None, examples: int = 3) -> DataFrame:
    """One row per table and column: type, description, null rate, distinct values, range and first examples.

    Ranges and null counts come from one plain aggregation per table; distinct counts and examples of all tables from one (table, column, value)
    reduction, counted map-side first.
    """
    ends = [_ends(df).withColumn("table", F.lit(name)) for name, df in tables.items()]
    cells = [_cells(df).select(F.lit(name).alias("table"), "column", "value") for name, df in tables.items()]
    v = reduce(DataFrame.unionByName, cells).where(F.col("value").isNotNull()).distinct()
    v = write_shared(v, "dictionary-values")
    stats = v.groupBy("table", "column").agg(F.count("*").alias("n_unique"))
    w = Window.partitionBy("table", "column").orderBy("value")
    firsts = v.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= examples).groupBy("table", "column").agg(
        F.concat_ws(", ", F.transform(F.array_sort(F.collect_list("value")), lambda x: F.substring(x, 1, 40))).alias("examples"))
    text = F.lit("") if not descriptions else F.coalesce(C.lookup("column", descriptions), F.lit(""))
    out = reduce(DataFrame.unionByName, ends).join(stats, ["table", "column"], "left").join(firsts, ["table", "column"], "left")
    return out.select("table", "column", "dtype", text.alias("description"), F.round(C.ratio("_nulls", "_rows"), 4).alias("null_rate"),
                      F.coalesce("n_unique", F.lit(0)).alias("n_unique"), "min", "max", F.coalesce("examples", F.lit("")).alias("examples"))


def _cells(df: DataFrame) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns])))


def _ends(df: DataFrame) -> DataFrame:
    """column, dtype, min, max (of numbers and times), _nulls, _rows."""
    ranged = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.DateType))]
    ends = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in df.columns],
                  *[F.min(c).cast("string").alias(f"lo_{c}") for c in ranged],
                  *[F.max(c).cast("string").alias(f"hi_{c}") for c in ranged])
    nothing = F.lit(None).cast("string")
    return ends.select("_rows", F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(_type_name(f.dataType)).alias("dtype"), F.col(f"no_{f.name}").alias("_nulls"),
                 (F.col(f"lo_{f.name}") if f.name in ranged else nothing).alias("min"),
                 (F.col(f"hi_{f.name}") if f.name in ranged else nothing).alias("max"))
        for f in df.schema])))
