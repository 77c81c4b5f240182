"""Row numbers and running totals over a whole table, without a single task that sees all rows.

The table is dealt into ranges of the order and stored, every range is summed on its own, and the totals of the ranges before it are added
back. Only one row per range (as many as shuffle partitions) reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.session import write_shared

_RANGE = "__range"


def totals_before(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with a column for each of ``sums``: its total over all rows that come before in ``order``, zero for the first.

    ``order`` should tell rows apart (aggregate rows with equal keys first); otherwise the sequence of equal rows is arbitrary. Nulls in a sum count as zero.
    """
    ranged = write_shared(df.repartitionByRange(*order).withColumn(_RANGE, F.spark_partition_id()), "ranged")
    per = ranged.groupBy(_RANGE).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()])
    found = sorted(per.collect())
    before = {k: list(accumulate((r[k] for r in found), initial=0)) for k in sums}
    kinds = [F.col(_RANGE)] + [F.col(k).cast(per.schema[k].dataType).alias(f"{_RANGE}_{k}") for k in sums]
    rows = [(r[_RANGE], *(before[k][i] for k in sums)) for i, r in enumerate(found)]
    offsets = df.sparkSession.createDataFrame(rows, per.schema).select(*kinds)
    sofar = Window.partitionBy(_RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = {k: F.coalesce(F.sum(c).over(sofar), F.lit(0)) + F.col(f"{_RANGE}_{k}") for k, c in sums.items()}
    return ranged.join(F.broadcast(offsets), _RANGE).select(*df.columns, *[v.alias(k) for k, v in totals.items()])


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with its row number in ``order``, from 0."""
    return totals_before(df, order, {name: F.lit(1).cast("long")})


def with_halo(df: DataFrame, order: list[Column], rows: int, bucket: int = 4096, **aggregates: Column) -> DataFrame:
    """``df`` with each of ``aggregates`` over the ``rows`` rows before it in ``order``.

    The sequence is cut into buckets of ``bucket`` rows; the last rows of a bucket also go to the next one, as its halo, so every
    bucket is a window of its own. ``order`` should tell rows apart.
    """
    if rows > bucket:
        raise ValueError(f"{rows} rows before do not fit a bucket of {bucket}")
    placed = numbered(df, order, "__at").withColumn("__bucket", F.expr(f"__at div {bucket}"))
    late = F.col("__at") % bucket >= bucket - rows
    places = F.array_compact(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(True).alias("own")),
                                     F.when(late, F.struct((F.col("__bucket") + 1).alias("b"), F.lit(False).alias("own")))))
    dealt = placed.withColumn("__deal", F.explode(places))
    before = Window.partitionBy("__deal.b").orderBy("__at").rowsBetween(-rows, -1)
    return dealt.select("*", *[c.over(before).alias(k) for k, c in aggregates.items()]).where("__deal.own").select(*df.columns, *aggregates)
