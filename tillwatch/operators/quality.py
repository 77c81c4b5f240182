"""Data-quality checks for many files at once.

Results are long: file, check, severity, status, failed_rows, detail. Every check is a count, so no file is ever
gathered in one place: rows are reduced to distinct rows per file, key columns to (file, column, key), and only those
reductions meet the reference keys.

Files depend on earlier ones (a customer file makes its customers known, a loaded id may not come again). Instead of a
loop each key carries the place in the processing order from which it is known; a file is judged as if all earlier ones
had been accepted, which is the only case in which its verdict matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.prefix import with_halo
from tillwatch.functions.tables import union_on
from tillwatch.functions.temporal import array_median
from tillwatch.schema import CAMPAIGN_TYPES, ERROR_GROUPS, GENDERS, PAYING_METHODS, PLATFORMS, REFERENCE_KEYS, TICKETS
from tillwatch.session import write_shared
from tillwatch.sources.files import REQUIRED

# fixed values: the thresholds and severities decide which files are loaded
KEY_COLUMNS = ["ticket_id", "customer_id", "time", "status_id", "paying_method"]
NUMBERS = ["original_price", "discount_value", "final_price", "customer_id", "status_id", "campaign_id"]
PRICE_TOLERANCE = 0.01
VOLUME_LOW, VOLUME_HIGH, VOLUME_WINDOW, VOLUME_MIN = 0.1, 10.0, 28, 7
ERROR, WARNING = "error", "warning"
DOMAINS = {
    "customer": ("usergender", GENDERS, WARNING),
    "campaign": ("campaign_type", CAMPAIGN_TYPES, WARNING),
    "device_detail": ("platform", PLATFORMS, WARNING),
    "status_detail": ("error_group", ERROR_GROUPS, ERROR),
}
WHOLE = {"customer": ["customer_id"], "campaign": ["campaign_id"], "device_detail": [], "status_detail": ["status_id"]}
DATES = {"customer": ["dob"], "campaign": [], "device_detail": [], "status_detail": []}
# (check, severity, key column it looks at)
KEY_CHECKS = [("unknown_status", ERROR, "status_id"), ("unknown_customer", ERROR, "customer_id"),
              ("unknown_campaign", ERROR, "campaign_id"), ("unknown_device", WARNING, "device_number"),
              ("unknown_paying_method", WARNING, "paying_method")]
CHECK_ORDER = ["schema", "not_empty", "parse_types", "key_nulls", "exact_duplicates", "ticket_id_conflict", "already_loaded",
               *[c for c, _, _ in KEY_CHECKS], "price_rules", "date_matches_file", "volume", "key_conflict",
               *[f"invalid_{c}" for c, _, _ in DOMAINS.values()], "updates_existing"]


def _start() -> Column:
    """The place in the order before every file."""
    return F.struct(F.lit("").alias("d"), F.lit(0).alias("t"), F.lit("").alias("f"))


def known_keys(kind: str, df: DataFrame, order: Column | None = None) -> DataFrame:
    """Keys of a column as text with the place from which they are known."""
    key = F.col(kind) if kind in ("device_number", "ticket_id", "paying_method") else C.parse_whole(kind)
    return df.select(F.lit(kind).alias("column"), key.cast("string").alias("key"), (_start() if order is None else order).alias("known"))


def _number_ok(c: str) -> Column:
    return C.parse_number(c).isNull() & F.col(c).isNotNull()


def check_tickets(rows: DataFrame, files: DataFrame, known: DataFrame, history: DataFrame) -> DataFrame:
    """Checks of daily ticket files.

    ``rows``: file, file_date and the twelve ticket columns as text. ``files``: file, file_date, header (array).
    ``known``: column, key, known (see ``known_keys``). ``history``: file_date, rows of earlier loads.
    """
    required = F.array(*[F.lit(c) for c in REQUIRED[TICKETS]])
    files = files.select("file", "file_date", F.array_except(required, "header").alias("_missing"))
    cells = [F.col(c).cast("string").alias(c) for c in REQUIRED[TICKETS]]
    d = rows.select("file", "file_date", *cells).groupBy("file", "file_date", *REQUIRED[TICKETS]).agg(F.count("*").alias("_n"))
    stats = _row_checks(d)
    keys = _key_checks(d, known)
    f = files.join(stats, "file", "left").join(keys, "file", "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    f = write_shared(f, "file-stats")  # one row per file, read by the volume check and below
    f = f.join(_volume(f, history), "file", "left")
    ok = F.size("_missing") == 0
    filled = ok & (F.col("_rows") > 0)
    check = lambda name, severity, n, detail=F.lit(""), when=filled: F.when(when, F.struct(
        F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.coalesce(n, F.lit(0)).cast("bigint").alias("failed_rows"),
        F.coalesce(detail, F.lit("")).alias("detail")))
    shown = lambda c: F.concat(F.lit("values: "), F.concat_ws(", ", F.col(f"_values_{c}")))
    checks = [
        check("schema", ERROR, F.size("_missing"), F.concat_ws(", ", "_missing"), F.lit(True)),
        check("not_empty", ERROR, (F.col("_rows") == 0).cast("int"), when=ok),
        check("parse_types", ERROR, F.col("_bad_types")),
        check("key_nulls", ERROR, F.col("_key_nulls"), F.col("_null_detail")),
        check("exact_duplicates", WARNING, F.col("_duplicates")),
        check("ticket_id_conflict", ERROR, F.col("_conflict")),
        check("already_loaded", ERROR, F.col("_loaded")),
        *[check(name, severity, F.col(f"_unknown_{c}"),
                shown(c) if c in ("status_id", "paying_method") else F.lit("")) for name, severity, c in KEY_CHECKS],
        check("price_rules", ERROR, F.col("_price")),
        check("date_matches_file", ERROR, F.col("_wrong_day")),
        check("volume", WARNING, F.when(F.col("_off"), F.col("_distinct")).otherwise(0), F.col("_volume_detail"),
              filled & F.col("_off").isNotNull()),
    ]
    return _long(f.select("file", "_rows", "_distinct", F.array_compact(F.array(*checks)).alias("_checks")))


def _long(f: DataFrame) -> DataFrame:
    out = f.select("file", F.col("_rows").alias("rows"), F.coalesce("_distinct", F.lit(0)).alias("kept_rows"), F.inline("_checks"))
    return out.withColumn("status", F.when(F.col("failed_rows") > 0, "fail").otherwise("pass"))


def _row_checks(d: DataFrame) -> DataFrame:
    """One row per file. Types and nulls count every delivered row, the rest distinct rows."""
    n = F.col("_n")
    t = C.parse_time("time")
    bad = t.isNull() & F.col("time").isNotNull()
    for c in NUMBERS:
        bad = bad | _number_ok(c)
    null = {c: F.col(c).isNull() for c in KEY_COLUMNS}
    any_null = F.exists(F.array(*null.values()), lambda x: x)
    o, v, p = (C.parse_number(c) for c in ("original_price", "discount_value", "final_price"))
    price = (C.is_true(o < 0) | C.is_true(v < 0) | C.is_true(p < 0) | C.is_true(v > o + PRICE_TOLERANCE)
             | C.is_true(F.abs(o - v - p) > PRICE_TOLERANCE))
    wrong_day = ~C.is_true(F.to_date(t) == F.col("file_date"))
    s = d.groupBy("file").agg(
        F.sum(n).alias("_rows"), F.count("*").alias("_distinct"), F.sum(n - 1).alias("_duplicates"),
        F.sum(F.when(bad, n)).alias("_bad_types"), F.sum(F.when(any_null, n)).alias("_key_nulls"),
        *[F.sum(F.when(x, n)).alias(f"_null_{c}") for c, x in null.items()],
        F.count_if(price).alias("_price"), F.count_if(wrong_day).alias("_wrong_day"))
    part = [F.when(F.col(f"_null_{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"_null_{c}").cast("string"))) for c in KEY_COLUMNS]
    return s.withColumn("_null_detail", F.concat_ws(", ", *part)).drop(*[f"_null_{c}" for c in KEY_COLUMNS])


def _key_checks(d: DataFrame, known: DataFrame) -> DataFrame:
    """Conflicts, repeated loads and unknown keys per file, from one reduction to (file, column, key)."""
    text = lambda c: F.struct(F.lit(c).alias("column"), F.col(c).alias("key"))
    # what is no whole number keeps its text and so is unknown
    whole = lambda c: F.struct(F.lit(c).alias("column"), F.coalesce(C.parse_whole(c).cast("string"), F.col(c)).alias("key"))
    cells = F.array(text("ticket_id"), whole("status_id"), whole("customer_id"), whole("campaign_id"), text("device_number"),
                    text("paying_method"))
    k = d.select("file", "file_date", F.inline(cells)).groupBy("file", "file_date", "column", "key").agg(F.count("*").alias("n"))
    k = write_shared(k, "keys")  # read by every step below; its size then decides the joins
    k = k.withColumn("_order", F.struct(F.col("file_date").cast("string").alias("d"), F.lit(1).alias("t"), F.col("file").alias("f")))
    pending = k.where(F.col("column") == "ticket_id").select("column", "key", F.col("_order").alias("known"))
    methods = F.array(*[F.lit(m) for m in PAYING_METHODS])
    fixed = F.when(F.col("column") == "paying_method", C.is_true(F.array_contains(methods, F.col("key"))))
    fixed = fixed.when((F.col("column") == "campaign_id") & (F.col("key") == "0"), True)
    # a day's keys meet the whole warehouse and the whole reference tables: only keys that occur in the files go on
    known = known.join(k.select("column", "key").distinct(), ["column", "key"], "left_semi")
    first = union_on([known, pending], "column", "key").where(F.col("key").isNotNull()).groupBy("column", "key").agg(F.min("known").alias("known"))
    j = k.join(first, ["column", "key"], "left").withColumn(
        "_seen", F.coalesce(fixed, F.col("known") < F.col("_order"), F.lit(False)))
    unknown = ~F.col("_seen")
    ticket = F.col("column") == "ticket_id"
    sums = j.groupBy("file").agg(
        F.sum(F.when(ticket & (F.col("n") > 1), F.col("n"))).alias("_conflict"),
        F.sum(F.when(ticket & F.col("_seen"), F.col("n"))).alias("_loaded"),
        *[F.sum(F.when((F.col("column") == c) & unknown, F.col("n"))).alias(f"_unknown_{c}") for _, _, c in KEY_CHECKS])
    shown = (  # distinct values of one file
        j.where(F.col("column").isin("status_id", "paying_method") & unknown & F.col("key").isNotNull())
        .groupBy("file").agg(*[F.array_sort(F.collect_list(F.when(F.col("column") == c, F.col("key")))).alias(f"_values_{c}")
                               for c in ("status_id", "paying_method")]))
    return sums.join(shown, "file", "left")


def _volume(f: DataFrame, history: DataFrame) -> DataFrame:
    """Each file's rows against the median of the 28 loads before it; null when there are fewer than 7."""
    now = f.where(F.col("_rows") > 0).select(
        "file", F.struct(F.lit(1).alias("s"), F.col("file_date").cast("string").alias("d"), F.col("file").alias("f")).alias("o"),
        F.col("_distinct").cast("double").alias("n"))
    past = history.select(F.lit(None).cast("string").alias("file"), F.struct(
        F.lit(0).alias("s"), F.col("file_date").cast("string").alias("d"), F.lit("").alias("f")).alias("o"),
        F.col("rows").cast("double").alias("n"))
    v = with_halo(now.unionByName(past), [F.col("o")], VOLUME_WINDOW, _past=F.collect_list("n")).where(F.col("file").isNotNull())
    median = array_median(F.col("_past"))
    v = v.withColumn("_median", F.when(F.size("_past") >= VOLUME_MIN, median))
    r = F.col("n") / F.nullif(F.col("_median"), F.lit(0.0))
    off = F.when(F.col("_median").isNotNull(), F.coalesce((r < VOLUME_LOW) | (r > VOLUME_HIGH), F.lit(True)))
    detail = F.concat(F.format_number("n", 0), F.lit(" rows, median "), F.format_number("_median", 0))
    return v.select("file", off.alias("_off"), detail.alias("_volume_detail"))


def check_reference(kind: str, rows: DataFrame, files: DataFrame, current: DataFrame) -> DataFrame:
    """Checks of the update files of one reference table; ``current`` is the table before all of them."""
    key, required = REFERENCE_KEYS[kind], REQUIRED[kind]
    column, allowed, severity = DOMAINS[kind]
    files = files.select("file", "file_date", F.array_except(F.array(*[F.lit(c) for c in required]), "header").alias("_missing"))
    d = rows.select("file", "file_date", *[F.col(c).cast("string").alias(c) for c in required])
    d = d.groupBy("file", "file_date", *required).agg(F.count("*").alias("_n"))
    bad = F.lit(False)
    for c in WHOLE[kind]:
        bad = bad | _number_ok(c)
    for c in DATES[kind]:
        bad = bad | (C.parse_date(c).isNull() & F.col(c).isNotNull())
    invalid = ~C.is_true(F.col(column).isin(allowed))
    if kind == "status_detail":
        invalid = invalid & ~C.is_true(C.parse_whole("status_id") == 1)  # success has no error group
    n = F.col("_n")
    stats = d.groupBy("file").agg(
        F.sum(n).alias("_rows"), F.count("*").alias("_distinct"), F.sum(n - 1).alias("_duplicates"),
        F.sum(F.when(bad, n)).alias("_bad"), F.sum(F.when(F.col(key).isNull(), n)).alias("_nulls"),
        F.count_if(invalid).alias("_invalid"))
    per_key = d.groupBy("file", "file_date", key).agg(
        F.count("*").alias("n"), F.min(F.struct(*[C.col(c) for c in required if c != key])).alias("v"))
    conflicts = per_key.groupBy("file").agg(F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("_conflict"))
    f = (
        files.join(stats, "file", "left").join(conflicts, "file", "left")
        .join(_changes(kind, per_key, current), "file", "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    )
    ok = F.size("_missing") == 0
    filled = ok & (F.col("_rows") > 0)
    sound = filled & (F.coalesce("_bad", F.lit(0)) == 0) & (F.coalesce("_nulls", F.lit(0)) == 0)
    check = lambda name, s, c, detail=F.lit(""), when=sound: F.when(when, F.struct(
        F.lit(name).alias("check"), F.lit(s).alias("severity"), F.coalesce(c, F.lit(0)).cast("bigint").alias("failed_rows"),
        detail.alias("detail")))
    checks = [
        check("schema", ERROR, F.size("_missing"), F.concat_ws(", ", "_missing"), F.lit(True)),
        check("not_empty", ERROR, (F.col("_rows") == 0).cast("int"), when=ok),
        check("parse_types", ERROR, F.col("_bad"), when=filled),
        check("key_nulls", ERROR, F.col("_nulls"), when=filled),
        check("exact_duplicates", WARNING, F.col("_duplicates")),
        check("key_conflict", ERROR, F.col("_conflict")),
        check(f"invalid_{column}", severity, F.col("_invalid")),
        check("updates_existing", WARNING, F.col("_changed")),
    ]
    return _long(f.select("file", "_rows", "_distinct", F.array_compact(F.array(*checks)).alias("_checks")))


def _changes(kind: str, per_key: DataFrame, current: DataFrame) -> DataFrame:
    """Rows per file that change the newest earlier version of their key (one row per key and file, so a window over
    a key is no longer than the number of files)."""
    key = REFERENCE_KEYS[kind]
    norm = C.parse_whole(key).cast("string") if key in WHOLE[kind] else F.col(key).cast("string")
    values = [c for c in REQUIRED[kind] if c != key]
    form = lambda c: (C.parse_date(c) if c in DATES[kind] else F.col(c)).cast("string").alias(c)
    new = per_key.select("file", norm.alias("k"), "n", F.struct(F.col("file_date").cast("string").alias("d"), F.lit(0).alias("t"),
                         F.col("file").alias("f")).alias("o"), "v.*")
    new = new.select("file", "k", "n", "o", F.struct(*[form(c) for c in values]).alias("v"))
    old = current.select(F.lit(None).cast("string").alias("file"), norm.alias("k"), F.lit(1).cast("bigint").alias("n"),
                         _start().alias("o"), F.struct(*[form(c) for c in values]).alias("v"))
    old = old.join(new.select("k").distinct(), "k", "left_semi")  # only versions of delivered keys
    w = Window.partitionBy("k").orderBy("o")
    seen = union_on([new, old], "k").withColumn("_before", F.lag("v").over(w))
    changed = F.col("_before").isNotNull() & ~F.col("_before").eqNullSafe(F.col("v"))
    return seen.where(F.col("file").isNotNull()).groupBy("file").agg(F.sum(F.when(changed, F.col("n"))).alias("_changed"))


def summarize(results: DataFrame) -> DataFrame:
    """One row per file: rows, kept rows, status and the lists of failed checks, in the order of the checks."""
    place = F.array_position(F.array(*[F.lit(c) for c in CHECK_ORDER]), F.col("check"))
    # at most as many entries per file as there are checks
    failed = lambda s: F.transform(F.array_sort(F.collect_list(F.when(
        (F.col("status") == "fail") & (F.col("severity") == s), F.struct(place.alias("p"), F.col("check"))))), lambda x: x["check"])
    return results.groupBy("file").agg(
        F.max("rows").alias("rows"), F.max("kept_rows").alias("kept_rows"), failed(ERROR).alias("errors"), failed(WARNING).alias("warnings"),
    ).withColumn("status", F.when(F.size("errors") > 0, "failed").otherwise("passed"))


def warning_counts(log: DataFrame) -> DataFrame:
    """How many files raised each warning, from the log's joined text."""
    w = log.where(F.col("warnings") != "").select(F.explode(F.split("warnings", ";")).alias("warning"))
    return w.groupBy("warning").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "warning")


def log_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("files"), F.count_if(F.col("status") == "failed").alias("blocked"),
                   F.count_if(F.col("warnings") != "").alias("with_warnings"), F.max("date").alias("last_date"))
