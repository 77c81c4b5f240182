"""The daily load: gate all pending files in one pass, append what passes, quarantine the first bad file.

Folder layout below ``root``:

    incoming/                 CSV drops
    warehouse/ticket_history/ loaded attempts, partitioned by file_date
    warehouse/refs/<table>/   accepted reference rows (newest row per key wins)
    quarantine/<table>/       rows of blocked files with the failed checks
    state/                    one row per decided file
    log/quality, log/checks, log/daily_ops

Every row, of the logs and the quarantine too, carries the id of its load, and the state, written last, is the list of committed loads: readers see a
load whole or not at all, and a run that died half way is simply repeated.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tillwatch.functions import columns as C
from tillwatch.functions.tables import union_on
from tillwatch.operators import quality
from tillwatch.operators.clean import with_status
from tillwatch.schema import ERROR_GROUPS, REFERENCE_KEYS, SCHEMAS, TICKETS
from tillwatch.session import write_shared
from tillwatch.sources import files as fs

RESENT = "file_resent_with_different_content"
CANNOT_SPLIT = "cannot_split_export"
STATE = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("file_date", T.DateType()),
    T.StructField("file_size", T.LongType()), T.StructField("status", T.StringType()), T.StructField("rows", T.LongType()),
    T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("decided_at", T.TimestampType()), T.StructField("load_id", T.StringType()),
])


@dataclass
class Paths:
    root: str

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder, empty when it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def _stored_schema(kind: str) -> T.StructType:
    extra = [T.StructField("file", T.StringType()), T.StructField("load_id", T.StringType()), T.StructField("file_date", T.DateType())]
    return T.StructType([*SCHEMAS[kind].fields, *extra])


def _committed(spark: SparkSession, paths: Paths, path: str, schema: T.StructType) -> DataFrame:
    """Rows of loads that reached the state (one id per load, a small table)."""
    loads = _read(spark, paths.at("state"), STATE).select("load_id").distinct()
    return _read(spark, paths.at(path), schema).join(loads, "load_id", "left_semi")


def read_warehouse(spark: SparkSession, paths: Paths) -> DataFrame:
    """All loaded attempts; filters on ``file_date`` prune folders."""
    return _committed(spark, paths, f"warehouse/{TICKETS}", _stored_schema(TICKETS))


def loaded_ids(spark: SparkSession, paths: Paths) -> DataFrame:
    return read_warehouse(spark, paths).select("ticket_id")


def latest_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Newest row per key by a map-side combined maximum."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_v")).select(key, *[F.col(f"_v.{c}").alias(c) for c in rest])


def load_refs(spark: SparkSession, paths: Paths, base: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Current reference tables: the base table with accepted updates replacing or adding keys."""
    out = {}
    for kind, key in REFERENCE_KEYS.items():
        names = [f.name for f in SCHEMAS[kind]]
        new = _committed(spark, paths, f"warehouse/refs/{kind}", _stored_schema(kind)).select(
            *names, F.struct(F.col("file_date").cast("string"), "file").alias("_order"))
        out[kind] = upsert(base[kind].select(*names), latest_per_key(new, key, "_order").select(*names), key)
    return out


def upsert(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of ``batch`` replace those with the same key, the others are added."""
    return union_on([current.join(batch.select(key), key, "left_anti"), batch], key)


def read_state(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per file: loaded, or failed unless a later file of the same table and day was loaded."""
    state = _read(spark, paths.at("state"), STATE)
    loaded = state.where(F.col("status") == "loaded")
    good = loaded.groupBy("kind", "file_date").agg(F.max("decided_at").alias("_good"))
    failed = state.where(F.col("status") == "failed").join(good, ["kind", "file_date"], "left")
    open_ = failed.where(F.col("_good").isNull() | (F.col("_good") < F.col("decided_at"))).drop("_good")
    newest = open_.groupBy("file").agg(F.max_by(F.struct(*STATE.names), "decided_at").alias("s")).select("s.*")
    return loaded.unionByName(newest)


def status(spark: SparkSession, paths: Paths) -> DataFrame:
    """Loaded ticket files, last date, reference updates per table, pending, failed and unrecognized files in one row."""
    s = read_state(spark, paths)
    ok, tickets = F.col("status") == "loaded", F.col("kind") == TICKETS
    listed = fs.list_files(spark, paths.at("incoming"))
    pending = listed.join(s.where(ok).select("file"), "file", "left_anti")
    return s.agg(
        F.count_if(ok & tickets).alias("loaded_ticket_files"), F.max(F.when(ok & tickets, F.col("file_date"))).alias("last_loaded_date"),
        *[F.count_if(ok & (F.col("kind") == k)).alias(f"{k}_files") for k in REFERENCE_KEYS],
        F.count_if(F.col("status") == "failed").alias("failed_files"),
    ).withColumn("pending_files", pending.agg(F.count("*")).scalar()).withColumn("unrecognized_files", fs.unrecognized(listed).agg(F.count("*")).scalar())


def decide(summaries: DataFrame) -> DataFrame:
    """accept / quarantine / pending per file: nothing after the first failed file is loaded.

    ``summaries`` has one row per file with kind, file_date, status, errors.
    """
    order = fs.file_order()
    first_bad = summaries.agg(F.min(F.when(F.col("status") == "failed", order))).scalar()
    verdict = F.when(first_bad.isNull() | (order < first_bad), "accept").when(order == first_bad, "quarantine").otherwise("pending")
    return summaries.withColumn("decision", verdict)


def known_keys(refs: dict[str, DataFrame], ids: DataFrame, updates: dict[str, DataFrame]) -> DataFrame:
    """Every key a ticket may refer to with the place in the order from which it is known."""
    out = quality.known_keys("ticket_id", ids)
    for kind, key in REFERENCE_KEYS.items():
        out = out.unionByName(quality.known_keys(key, refs[kind]))
        if kind in updates:
            order = F.struct(F.col("file_date").cast("string").alias("d"), F.lit(0).alias("t"), F.col("file").alias("f"))
            out = out.unionByName(quality.known_keys(key, updates[kind], order))
    return out


def gate(rows: dict[str, DataFrame], files: DataFrame, refs: dict[str, DataFrame], ids: DataFrame, history: DataFrame) -> DataFrame:
    """Check results of all pending files. ``rows``: table -> rows as text; ``files``: file, kind, file_date, header."""
    updates = {k: v for k, v in rows.items() if k != TICKETS}
    parts = []
    for kind, r in rows.items():
        f = files.where(F.col("kind") == kind)
        if kind == TICKETS:
            parts.append(quality.check_tickets(r, f, known_keys(refs, ids, updates), history))
        else:
            parts.append(quality.check_reference(kind, r, f, refs[kind]))
    return union_on(parts, "file")


def resent(files: DataFrame, decisions: DataFrame) -> DataFrame:
    """Add ``resent``: null for work to do, 'same' for files decided before, 'changed' for a loaded name whose size
    differs. ``decisions`` holds every decision ever made."""
    sizes = decisions.groupBy("file").agg(
        F.max(F.when(F.col("status") == "loaded", F.struct("file_size"))).alias("_ok"),
        # a blocked file stays where it is; the set of its delivered versions is small
        F.collect_set(F.when(F.col("status") == "failed", F.col("file_size"))).alias("_bad"))
    old = F.col("_ok.file_size")
    seen = F.array_contains("_bad", F.col("file_size")) | (F.col("_ok").isNotNull() & (old.isNull() | (old == F.col("file_size"))))
    return files.join(sizes, "file", "left").withColumn(
        "resent", F.when(seen, "same").when(F.col("_ok").isNotNull(), "changed")).drop("_ok", "_bad")


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """Text rows of an accepted file with the table's types; exact duplicates removed within the file."""
    cast = {T.LongType(): C.parse_whole, T.IntegerType(): lambda c: C.parse_whole(c).try_cast("int"), T.DoubleType(): C.parse_number,
            T.TimestampType(): C.parse_time, T.StringType(): F.col}
    cols = [cast[f.dataType](f.name).alias(f.name) for f in SCHEMAS[kind]]
    return rows.dropDuplicates().select(*cols, "file_date", "file")


def daily_ops(tickets: DataFrame, status_table: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, successes, success rate, revenue and errors per group of each day."""
    d = with_status(tickets, status_table)
    return d.groupBy(*by).agg(
        F.count("*").alias("tickets"), F.count_if("is_success").alias("success"),
        F.round(C.rate("is_success"), 4).alias("success_rate"),
        F.round(F.coalesce(F.sum(F.when(F.col("is_success"), C.money("final_price"))), F.lit(0)), 2).cast("double").alias("revenue"),
        *[F.count_if(F.col("is_failed") & (F.col("error_group") == g)).alias(f"errors_{g}") for g in ERROR_GROUPS])


def _append(df: DataFrame, path: str, partition_by: list[str], rows_per_task: int = 1_000_000) -> None:
    """Append rows that carry ``kept_rows`` of their file.

    A file goes to one task, or to one per million rows when it is larger, so a day that holds a third of all rows is
    written by many tasks and small days do not turn into many tiny files. Uncommitted loads are invisible to readers,
    so tasks may publish their files themselves (committer version 2) instead of one rename loop on the driver.
    """
    parts = F.ceil(F.col("kept_rows") / rows_per_task).cast("int")
    salt = F.when(parts > 1, F.pmod(F.xxhash64(*[c for c in df.columns if c != "kept_rows"]), parts)).otherwise(0)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(tasks, "file_date", salt).drop("kept_rows").write.mode("append")
     .option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(*partition_by).parquet(path))


def _read_log(spark: SparkSession, paths: Paths, name: str) -> DataFrame:
    return _committed(spark, paths, name, spark.read.parquet(paths.at(name)).schema).drop("load_id")


def read_daily_ops(spark: SparkSession, paths: Paths) -> DataFrame:
    """The daily operations log of committed loads."""
    return _read_log(spark, paths, "log/daily_ops")


def read_quality_log(spark: SparkSession, paths: Paths) -> DataFrame:
    """One row per judged file of committed loads: file, date, rows, status, errors, warnings, checked_at."""
    return _read_log(spark, paths, "log/quality")


def read_check_log(spark: SparkSession, paths: Paths) -> DataFrame:
    """The check results, as JSON, of each judged file of committed loads."""
    return _read_log(spark, paths, "log/checks")


def read_quarantine(spark: SparkSession, paths: Paths) -> DataFrame:
    """The records of blocked files of committed loads, with the failed checks."""
    return _read_log(spark, paths, "quarantine")


def unrecognized_files(spark: SparkSession, paths: Paths) -> DataFrame:
    """Names in the drop folder outside the naming convention; they are reported and never loaded."""
    return fs.unrecognized(fs.list_files(spark, paths.at("incoming")))


def run(spark: SparkSession, paths: Paths, base_refs: dict[str, DataFrame], until: str | None = None) -> DataFrame:
    """Load every pending file up to ``until``; returns one row per file with its decision."""
    decisions = _read(spark, paths.at("state"), STATE)
    # one row per file in the folder; fixing it keeps every later step on the same set of files
    listing = write_shared(resent(fs.until(fs.list_files(spark, paths.at("incoming")), until), decisions), "listing")
    fresh = listing.where((F.col("kind").isNotNull() | F.col("is_export")) & F.col("resent").isNull())
    names = [r["file"] for r in fresh.select("file").collect()]  # file names only, as in any file scan
    if not names:
        return _decided(spark, paths, listing, None)
    # text is read once; all later steps read stored tables
    headers, data = fs.split_header(fs.read_lines(spark, [paths.at(f"incoming/{n}") for n in names]))
    data = write_shared(data.join(fresh.select("file", "kind", "file_date", "is_export"), "file"), "lines")
    headers = write_shared(headers, "headers")

    broken = fs.unsplittable(data)
    if not broken.isEmpty():
        bad = write_shared(broken.join(listing.select("file", "file_date", "file_size"), "file").select(
            "file", F.lit(TICKETS).alias("kind"), "file_date", "file_size", F.lit("failed").alias("status"), "rows",
            F.array(F.lit(CANNOT_SPLIT)).alias("errors"), F.array().cast("array<string>").alias("warnings")), "broken")
        load_id = uuid.uuid4().hex
        _quarantine(paths, data.join(bad.select("file", "errors"), "file"), load_id)
        _write_state(paths, bad, load_id)
        return bad.withColumn("kept_rows", F.lit(0).cast("bigint")).withColumn("decision", F.lit("quarantine"))

    data = fs.split_exports(data)
    parts = data.where(F.col("export_file").isNotNull()).select(
        "file", "kind", "file_date", F.lit(None).cast("bigint").alias("file_size"), F.col("export_file").alias("source")).distinct()
    parts = fs.until(parts, until).join(decisions.select("file"), "file", "left_anti")  # days of an export decided before
    files = parts.unionByName(fresh.where("NOT is_export").select("file", "kind", "file_date", "file_size", F.col("file").alias("source")))
    header = headers.select(F.col("file").alias("source"), "header")
    files = files.join(header, "source", "left").drop("source").withColumn("header", F.coalesce("header", F.array().cast("array<string>")))
    files = write_shared(files, "files")
    return _judge(spark, paths, base_refs, listing, files, data.join(files.select("file"), "file", "left_semi"))


def _judge(spark: SparkSession, paths: Paths, base_refs: dict[str, DataFrame], listing: DataFrame, files: DataFrame,
           data: DataFrame) -> DataFrame:
    state, load_id = read_state(spark, paths), uuid.uuid4().hex
    kinds = [r["kind"] for r in files.select("kind").distinct().collect()]  # at most five
    if not kinds:
        return _decided(spark, paths, listing, None)
    rows = {k: fs.table_rows(data, k) for k in kinds}
    refs = load_refs(spark, paths, base_refs)
    history = state.where((F.col("status") == "loaded") & (F.col("kind") == TICKETS)).select("file_date", "rows")
    checks = write_shared(gate(rows, files, refs, loaded_ids(spark, paths), history), "checks")
    decided = _decided(spark, paths, listing, quality.summarize(checks).join(files.drop("header"), "file"))

    accepted = decided.where(F.col("decision") == "accept").select("file", "kept_rows", F.col("kind").alias("_kind"))
    for kind in kinds:
        target = f"warehouse/{kind}" if kind == TICKETS else f"warehouse/refs/{kind}"
        ok = typed(rows[kind], kind).join(accepted.where(F.col("_kind") == kind).drop("_kind"), "file")
        _append(ok.withColumn("load_id", F.lit(load_id)), paths.at(target), ["file_date"] if kind == TICKETS else [])
    blocked = decided.where(F.col("decision") == "quarantine").select("file", "errors")
    _quarantine(paths, data.join(blocked, "file"), load_id)
    handled = decided.where(F.col("decision") != "pending")
    stamp = F.current_timestamp()
    # files after the blocked one were not judged in the end: they stay pending and leave no log
    log = handled.select("file", F.col("file_date").alias("date"), "rows", "status", F.concat_ws(";", "errors").alias("errors"),
                         F.concat_ws(";", "warnings").alias("warnings"), stamp.alias("checked_at"))
    log.withColumn("load_id", F.lit(load_id)).write.mode("append").parquet(paths.at("log/quality"))
    report = checks.join(handled.select("file", "kind", "file_date"), "file").groupBy("file", "kind", "file_date").agg(
        F.collect_list(F.struct("check", "severity", "status", "failed_rows", "detail")).alias("checks"))
    report.withColumn("checks", F.to_json("checks")).withColumn("load_id", F.lit(load_id)).write.mode("append").parquet(paths.at("log/checks"))
    if TICKETS in kinds:
        loaded = typed(rows[TICKETS], TICKETS).join(accepted.select("file"), "file", "left_semi")
        ops = daily_ops(loaded, load_refs(spark, paths, base_refs)["status_detail"], ["file_date", "file"])
        ops.withColumn("load_id", F.lit(load_id)).write.mode("append").parquet(paths.at("log/daily_ops"))
    _write_state(paths, handled.withColumn("status", F.when(F.col("decision") == "accept", "loaded").otherwise("failed"))
                 .withColumn("rows", F.col("kept_rows")), load_id)
    return decided


def _decided(spark: SparkSession, paths: Paths, listing: DataFrame, summary: DataFrame | None) -> DataFrame:
    """Decisions on judged files together with loaded files that were sent again with other content."""
    empty = F.array().cast("array<string>")
    changed = listing.where(F.col("resent") == "changed").select(
        "file", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("kept_rows"),
        F.array(F.lit(RESENT)).alias("errors"), empty.alias("warnings"), F.lit("failed").alias("status"), "kind", "file_date", "file_size")
    decided = write_shared(decide(changed if summary is None else summary.unionByName(changed)), "decided")
    if summary is None:
        _write_state(paths, decided.where(F.col("decision") == "quarantine"))
    return decided


def _quarantine(paths: Paths, rows: DataFrame, load_id: str) -> None:
    rows.select("file", "kind", "header", "values", "errors", F.lit(load_id).alias("load_id")).write.mode("append").parquet(paths.at("quarantine"))


def _write_state(paths: Paths, decided: DataFrame, load_id: str | None = None) -> None:
    decided.withColumn("decided_at", F.current_timestamp()).withColumn("load_id", F.lit(load_id).cast("string")).select(*STATE.names).write.mode("append").parquet(paths.at("state"))


class DataQualityError(RuntimeError):
    """A blocked file: no report may be made."""


def require_clean(decided: DataFrame) -> None:
    bad = decided.where(F.col("decision") == "quarantine").select("file", "errors").limit(1).collect()
    if bad:
        raise DataQualityError(f"file {bad[0]['file']} failed {bad[0]['errors']}; no report was made")
