"""Records of CSV files whose byte ranges are read in parallel, quoted line breaks included.

Files are read as lines, so a large file fills many tasks and its text is read once. Whether a line starts inside a quoted cell depends on all
lines before it, but a line only maps the state before it (outside, inside) to the state after it, and such maps compose: lines are composed
within their byte range, ranges within their file, and both are window functions over bounded groups. Files without an
open quote, as a rule all of them, skip that step.

Quotes: a cell that starts with a quote ends at the next single one; two of them stand for one. A quote inside an unquoted cell is a character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.session import write_shared

OUTSIDE, INSIDE, CLOSED = 0, 1, 2
_CELL = r'((?:"[^"]*+(?:""[^"]*+)*+")?[^,]*+),'


def _ends_inside(value: Column, start: int) -> Column:
    """Is a line that starts in this state inside a quoted cell at its end?"""
    parts = F.split(value, '"')  # what stands before each quote, and after the last
    before = F.slice(parts, 1, F.size(parts) - 1)

    def step(acc, text):
        opens = text.endswith(",") | ((text == "") & (acc["first"] | (acc["state"] == CLOSED)))
        state = F.when(acc["state"] == INSIDE, F.lit(CLOSED)).when(opens, F.lit(INSIDE)).otherwise(F.lit(OUTSIDE))
        return F.struct(state.alias("state"), F.lit(False).alias("first"))
    first = F.struct(F.lit(start).alias("state"), F.lit(start == OUTSIDE).alias("first"))
    ended = F.aggregate(before, first, step, lambda acc: acc["state"] == INSIDE)
    return F.when(F.contains(value, F.lit('"')), ended).otherwise(F.lit(start == INSIDE))


def _composed(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """``df`` with the states after each row if its group starts outside (after_out) or inside (after_in), from the states ``out`` and ``in`` that
    each row alone leads to."""
    sofar = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swap = (F.col("out") & ~F.col("in")).cast("long")
    df = df.withColumn("swaps", F.sum(swap).over(sofar))
    fixed = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("to"), "swaps"))
    df = df.withColumn("fixed", F.last(fixed, True).over(sofar))
    odd = lambda n: n % 2 == 1
    after = lambda start: F.when(F.col("fixed").isNotNull(), F.col("fixed.to") != odd(F.col("swaps") - F.col("fixed.swaps"))).otherwise(
        F.lit(start) != odd(F.col("swaps")))
    return df.withColumns({"after_out": after(False), "after_in": after(True)}).drop("swaps", "fixed")


def _joined(lines: DataFrame) -> DataFrame:
    """Lines of files with quoted line breaks as whole records, named by their first line."""
    lines = write_shared(_composed(lines.withColumns({"out": F.col("opens"), "in": _ends_inside(F.col("value"), INSIDE)}), ["file", "block"], "row"), "quoted-lines")
    ranges = lines.groupBy("file", "block").agg(F.max_by(F.struct(F.col("after_out").alias("out"), F.col("after_in").alias("in")), "row").alias("x"))
    ranges = _composed(ranges.select("file", "block", "x.*"), ["file"], "block")
    blocks = Window.partitionBy("file").orderBy("block")  # one row per byte range
    starts = ranges.select("file", "block", F.coalesce(F.lag("after_out").over(blocks), F.lit(False)).alias("starts_inside"))
    state = F.when(F.col("starts_inside"), F.col("after_in")).otherwise(F.col("after_out"))
    rows = lines.join(starts, ["file", "block"]).withColumn("ends", F.when(~state, F.struct("block", "row")))
    following = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = write_shared(rows.withColumn("end", F.first("ends", True).over(following)), "quoted-lines")
    later = rows.groupBy("file", "block").agg(F.min("ends").alias("first_end")).withColumn(
        "later", F.first("first_end", True).over(blocks.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.join(later.select("file", "block", "later"), ["file", "block"]).withColumn("end", F.coalesce("end", "later"))
    whole = rows.groupBy("file", "size", "end").agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("l"))  # one record
    return whole.select("file", "size", F.struct(F.col("l")[0]["block"].alias("block"), F.col("l")[0]["row"].alias("row")).alias("line"),
                        F.array_join(F.col("l.value"), "\n").alias("value"))


def records(spark: SparkSession, paths: list[str], pattern: str = "*.csv") -> DataFrame:
    """file, size, line, values of every record that is not blank: its cells as text, as many as it has. ``line`` (byte range, row) grows within a
    file. Records end at a line feed, a carriage return before it does not belong to them; nothing is trimmed."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).text(paths)
    lines = text.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("row"), "value")
    lines = write_shared(lines.withColumn("opens", _ends_inside(F.col("value"), OUTSIDE)), "raw-lines")
    quoted = lines.where("opens").select("file").distinct()
    out = lines.select("file", "size", F.struct("block", "row").alias("line"), "value")
    if not quoted.isEmpty():
        out = out.join(quoted, "file", "left_anti").unionByName(_joined(lines.join(quoted, "file", "left_semi")))
    record = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^﻿", "")
    return out.withColumn("value", record).where("value != ''").select("file", "size", "line", cells(F.col("value")).alias("values"))


def cells(record: Column) -> Column:
    """The cells of a record, without their quotes."""
    found = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1))
    bare = F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'(?s)^"(.*)"([^"]*)$', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(record, F.lit('"')), bare).otherwise(F.split(record, ","))
