"""Daily CSV drops: listing, names, and reading many files with differing column order in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.schema import REFERENCE_KEYS, SCHEMAS, TICKETS
from tillwatch.sources.csvlines import records

# fixed values: file naming and the texts that stand for a missing value
NAME = rf"^({'|'.join([TICKETS, *REFERENCE_KEYS])})_(\d{{4}}-\d{{2}}-\d{{2}})(__.+)?\.csv$"
EXPORT = rf"^{TICKETS}_(.+)\.csv$"
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
           "n/a", "nan", "null"]

REQUIRED = {name: [f.name for f in schema] for name, schema in SCHEMAS.items()}


def name_columns(file: str | Column) -> dict[str, Column]:
    """Kind and date from a file name; both null for names outside the convention."""
    f = C.col(file)
    part = lambda i: F.nullif(F.regexp_extract(f, NAME, i), F.lit(""))
    return {"kind": part(1), "file_date": part(2).try_cast("date")}


def file_order(kind: str = "kind", date: str = "file_date", file: str = "file") -> Column:
    """Processing order: by date, reference tables before tickets, then by name."""
    return F.struct(F.col(date).cast("string").alias("d"), (F.col(kind) == TICKETS).cast("int").alias("t"), F.col(file).alias("f"))


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """One row per CSV file with its size; the content is never read."""
    found = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "false").load(directory)
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("file_size"))
    )
    return found.withColumns(name_columns("file")).withColumn(
        "is_export", F.col("kind").isNull() & F.col("file").rlike(EXPORT))


def unrecognized(files: DataFrame) -> DataFrame:
    """Files outside the naming convention; they are never loaded."""
    return files.where(F.col("kind").isNull() & ~F.col("is_export")).select("file")


def until(files: DataFrame, last: str | None) -> DataFrame:
    """Only files up to a date; unnamed ones are left as they are."""
    return files if last is None else files.where(F.col("file_date").isNull() | (F.col("file_date") <= F.lit(last).cast("date")))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, file_size, line, values: the untyped cells of every record. ``line`` grows within a file. Quoted cells may hold commas and line
    breaks; byte ranges of a file are read by different tasks; nothing is trimmed."""
    values = F.transform("values", lambda v: F.when(~v.isin(MISSING), v))
    return records(spark, paths).select("file", F.col("size").alias("file_size"), "line", values.alias("values"))


def arrivals(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of newly arrived CSV files (the load reads their content itself)."""
    lines = spark.readStream.format("text").option("pathGlobFilter", "*.csv").option("maxFilesPerTrigger", files_per_batch)
    return lines.load(directory).select(F.col("_metadata.file_name").alias("file"))


def split_header(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, rows): one header per file, and data rows beside the header of their file.

    The header is the first record of a file, whatever it holds, so files may list their columns in any order, a missing column is
    noticed per file, and a data row that happens to hold column names stays a data row. Headers are one small row per file.
    """
    first = F.min(F.struct("line", "values", "file_size")).alias("first")
    headers = lines.groupBy("file").agg(first).select("file", F.col("first.values").alias("header"), F.col("first.file_size").alias("file_size"),
                                                      F.col("first.line").alias("head"))
    data = lines.where(F.exists("values", lambda v: v.isNotNull())).drop("file_size").join(headers.drop("file_size"), "file")
    return headers.drop("head"), data.where("line > head").drop("line", "head")


def cell(name: str) -> Column:
    """The text below a column name; null when the file has no such column."""
    return F.get("values", F.nullif(F.array_position("header", F.lit(name)), F.lit(0)).cast("int") - 1)


def table_rows(rows: DataFrame, kind: str) -> DataFrame:
    """The rows of one table with its required columns as text; absent columns are null."""
    cells = [cell(c).alias(c) for c in REQUIRED[kind]]
    return rows.where(F.col("kind") == kind).select("file", "file_date", *cells)


def split_exports(rows: DataFrame) -> DataFrame:
    """Give the rows of a multi-day export one daily file each, named after the day and the export."""
    day = F.to_date(C.parse_time(cell("time")))
    stem = F.regexp_replace("file", r"\.csv$", "")
    daily = F.concat(F.lit(f"{TICKETS}_"), F.date_format(day, "yyyy-MM-dd"), F.lit("__"), stem, F.lit(".csv"))
    return rows.withColumns({
        "export_file": F.when(F.col("is_export"), F.col("file")),
        "file_date": F.when(F.col("is_export"), day).otherwise(F.col("file_date")),
        "kind": F.when(F.col("is_export"), F.lit(TICKETS)).otherwise(F.col("kind")),
        "file": F.when(F.col("is_export"), daily).otherwise(F.col("file")),
    })


def unsplittable(rows: DataFrame) -> DataFrame:
    """Exports with a row whose time cannot be read: they are rejected whole."""
    bad = C.parse_time(cell("time")).isNull()
    return rows.where("is_export").groupBy("file").agg(F.bool_or(bad).alias("bad"), F.count("*").alias("rows")).where("bad")
