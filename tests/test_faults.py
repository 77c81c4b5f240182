"""Inputs that once lost or changed rows without notice."""

import datetime as dt

from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions import temporal
from tillwatch.operators import text
from tillwatch.sources import files as fs


def test_whole_numbers_and_times_are_not_bent(spark):
    rows = spark.createDataFrame([("2.7",), ("12.0",), ("12",), ("-3",), ("1e3",), ("9223372036854775807",), ("abc",), (None,), ("10:00:00",), ("inf",)], "v string")
    got = [r[0] for r in rows.select(C.parse_whole("v")).collect()]
    assert got == [None, 12, 12, -3, 1000, 9223372036854775807, None, None, None, None]
    times = spark.createDataFrame([("10:00:00",), ("2021-03-04 10:00:00.5",), ("2021-03-04",), ("T10:00",), (None,)], "v string")
    assert [r[0] for r in times.select(C.parse_time("v")).collect()] == [None, dt.datetime(2021, 3, 4, 10, 0, 0, 500000), dt.datetime(2021, 3, 4), None, None]
    assert times.select(C.parse_date("v").alias("d")).where("d IS NOT NULL").count() == 2


def test_files_keep_every_record_and_column(spark, tmp_path):
    wide = [f"extra{i}" for i in range(40)]
    names = ["ticket_id", "device_number", "movie_name", "time"]
    (tmp_path / "ticket_history_2021-01-01.csv").write_text(
        ",".join(wide + names) + "\n" + ",".join(["x"] * 40 + ["t1", "time", "movie_name", "2021-01-01 10:00:00"]) + "\n"
        + ",".join(["x"] * 40 + ["t2", "d", '"two\nlines, ""quoted"""', " 2021-01-01"]) + "\n")
    (tmp_path / "ticket_history_2021-01-02.csv").write_text("movie_name,ticket_id\n cash,t3\n#NA,t4\n\n")
    headers, data = fs.split_header(fs.read_lines(spark, [str(tmp_path)]))
    heads = {r.file: r.header for r in headers.collect()}
    assert len(heads) == 2 and [h for h in heads["ticket_history_2021-01-01.csv"] if h] == wide + names
    cells = [fs.cell(c).alias(c) for c in names]
    got = sorted(tuple(r) for r in data.select(*[F.coalesce(c, F.lit("-")) for c in cells]).collect())
    assert got == [("t1", "time", "movie_name", "2021-01-01 10:00:00"), ("t2", "d", 'two\nlines, "quoted"', " 2021-01-01"), ("t3", "-", " cash", "-"),
                   ("t4", "-", "-", "-")]


def test_rows_without_a_customer_belong_to_no_group(spark):
    at = lambda m: dt.datetime(2021, 1, 1, 10, m)
    rows = [(None, "a", at(0), False, True), (None, "b", at(5), True, False), (7, "c", at(1), False, True), (7, "d", at(3), True, False)]
    df = spark.createDataFrame(rows, "customer_id long, ticket_id string, time timestamp, is_success boolean, is_failed boolean")
    for hot in (1_000_000, 1):
        nxt = {r.ticket_id: r.next_success for r in temporal.with_next_success(df, False, hot_rows=hot).collect()}
        assert nxt == {"a": None, "b": None, "c": at(3), "d": at(3)}
        past = {r.ticket_id: (r.n_prev_attempts, r.n_prev_failed, r.prev_failed, r.prev_time) for r in temporal.with_history(df, hot).collect()}
        assert past == {"a": (0, 0, None, None), "b": (0, 0, None, None), "c": (0, 0, None, None), "d": (1, 1, True, at(1))}


def test_only_briefs_lose_their_provenance_lines(spark):
    body = "_Nguồn: somewhere\n" + "word " * 40
    doc = spark.createDataFrame([("s", "l", body)], "source string, label string, text string")
    plain = text.collect_passages(doc, separator="\n", joiner="\n").agg(F.concat_ws(" ", F.collect_list("text"))).first()[0]
    brief = text.collect_passages(doc.where("false"), separator="\n", joiner="\n", briefs=(doc,)).agg(F.concat_ws(" ", F.collect_list("text"))).first()[0]
    assert "somewhere" in plain and "somewhere" not in brief
