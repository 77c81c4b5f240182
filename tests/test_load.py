"""Quality checks by planted faults, and load scenarios with files on disk."""

import pytest

from tillwatch.plans import load
from tillwatch.schema import STATUS_ROWS

COLUMNS = ("ticket_id customer_id paying_method theater_name device_number original_price discount_value final_price time "
           "status_id campaign_id movie_name").split()
DAY = "2022-03-05"


def row(i, day=DAY, **changes):
    base = dict(ticket_id=f"t{day}-{i}", customer_id=1 + i % 3, paying_method="credit card", theater_name=7.0, device_number="d1",
                original_price=10.0, discount_value=1.0, final_price=9.0, time=f"{day} 10:00:0{i % 10}.000", status_id=1,
                campaign_id=0, movie_name="m")
    return {**base, **changes}


def write(folder, name, rows, columns=COLUMNS):
    lines = [",".join(columns)] + [",".join("" if r[c] is None else str(r[c]) for c in columns) for r in rows]
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def refs(spark):
    return {
        "customer": spark.createDataFrame([(i, "Male", "1990-01-01") for i in (1, 2, 3)], "customer_id bigint, usergender string, dob string"),
        "campaign": spark.createDataFrame([(50, "voucher")], "campaign_id bigint, campaign_type string"),
        "device_detail": spark.createDataFrame([("d1", "iPhone", "mobile")], "device_number string, model string, platform string"),
        "status_detail": spark.createDataFrame(STATUS_ROWS, "status_id int, description string, error_group string"),
    }


def go(spark, root, refs, **kw):
    out = load.run(spark, load.Paths(str(root)), refs, **kw)
    return {r["file"]: r for r in out.collect()}


FAULTS = {
    "unknown_status": dict(status_id=99),
    "key_nulls": dict(customer_id=None),
    "price_rules": dict(final_price=15.0),
    "unknown_customer": dict(customer_id=999999999),
    "unknown_campaign": dict(campaign_id=123456789),
    "date_matches_file": dict(time="2022-03-06 10:00:00.000"),
    "parse_types": dict(time="soon"),
}


def test_each_fault_is_found_by_its_check(spark, refs, tmp_path):
    """All faulted files are judged in one run; a file is judged as if the earlier ones had passed."""
    days = {}
    for n, (check, change) in enumerate(FAULTS.items(), 10):
        day = f"2022-03-{n}"
        rows = [row(i, day) for i in range(5)]
        if "time" in change and change["time"] != "soon":
            change = {"time": "2022-04-01 10:00:00.000"}
        rows[2] = {**rows[2], **change}
        write(tmp_path / "incoming", f"ticket_history_{day}.csv", rows)
        days[f"ticket_history_{day}.csv"] = check
    write(tmp_path / "incoming", "ticket_history_2022-03-05.csv", [row(i) for i in range(5)])
    write(tmp_path / "incoming", "ticket_history_2022-03-20.csv",
          [row(i, "2022-03-20", discount_value=-1.0, final_price=11.0) for i in range(2)])
    write(tmp_path / "incoming", "ticket_history_2022-03-21.csv", [row(i, "2022-03-21") for i in range(2)],
          [c for c in COLUMNS if c != "status_id"])
    dup = [row(0, "2022-03-22"), row(0, "2022-03-22")]
    write(tmp_path / "incoming", "ticket_history_2022-03-22.csv", dup + [row(1, "2022-03-22", device_number="new")])
    clash = [row(0, "2022-03-23"), row(0, "2022-03-23", movie_name="other")]
    write(tmp_path / "incoming", "ticket_history_2022-03-23.csv", clash)
    write(tmp_path / "incoming", "ticket_history_2022-03-24.csv", [row(0, "2022-03-22", time="2022-03-24 10:00:00.000")])
    out = go(spark, tmp_path, refs)
    for file, check in days.items():
        assert check in out[file]["errors"], (file, out[file])
        if check in ("unknown_status", "price_rules", "unknown_campaign", "date_matches_file"):
            assert out[file]["errors"] == [check]
    assert out["ticket_history_2022-03-05.csv"]["errors"] == [] and out["ticket_history_2022-03-05.csv"]["decision"] == "accept"
    assert out["ticket_history_2022-03-20.csv"]["errors"] == ["price_rules"]
    assert out["ticket_history_2022-03-21.csv"]["errors"] == ["schema"]
    assert out["ticket_history_2022-03-22.csv"]["errors"] == []
    # the eighth load already has a median of seven to be compared with
    assert [w for w in out["ticket_history_2022-03-22.csv"]["warnings"] if w != "volume"] == ["exact_duplicates", "unknown_device"]
    assert out["ticket_history_2022-03-22.csv"]["kept_rows"] == 2
    assert out["ticket_history_2022-03-23.csv"]["errors"] == ["ticket_id_conflict"]
    assert out["ticket_history_2022-03-24.csv"]["errors"] == ["already_loaded"]
    assert [f for f, r in out.items() if r["decision"] == "quarantine"] == ["ticket_history_2022-03-10.csv"]


def test_stop_at_bad_file_then_go_on(spark, refs, tmp_path):
    inc, p = tmp_path / "incoming", load.Paths(str(tmp_path))
    write(inc, "ticket_history_2022-03-05.csv", [row(i) for i in range(4)])
    write(inc, "ticket_history_2022-03-06.csv", [row(0, "2022-03-06", status_id=99)])
    write(inc, "ticket_history_2022-03-07.csv", [row(0, "2022-03-07")])
    write(inc, "notes.csv", [row(0)])
    first = go(spark, tmp_path, refs)
    assert {f: r["decision"] for f, r in first.items()} == {
        "ticket_history_2022-03-05.csv": "accept", "ticket_history_2022-03-06.csv": "quarantine", "ticket_history_2022-03-07.csv": "pending"}
    with pytest.raises(load.DataQualityError):
        load.require_clean(load.decide(spark.createDataFrame(
            [("a", "ticket_history", None, "failed", ["schema"])], "file string, kind string, file_date date, status string, errors array<string>")))
    assert load.read_warehouse(spark, p).count() == 4
    assert load.read_daily_ops(spark, p).count() == 1
    second = go(spark, tmp_path, refs)  # the blocked file is set aside, the next one is loaded
    assert {f: r["decision"] for f, r in second.items()} == {"ticket_history_2022-03-07.csv": "accept"}
    write(inc, "ticket_history_2022-03-06__fixed.csv", [row(0, "2022-03-06")])
    s = load.status(spark, p).collect()[0]
    assert (s["loaded_ticket_files"], s["failed_files"]) == (2, 1)
    assert go(spark, tmp_path, refs)["ticket_history_2022-03-06__fixed.csv"]["decision"] == "accept"
    s = load.status(spark, p).collect()[0]
    assert (s["loaded_ticket_files"], s["failed_files"], str(s["last_loaded_date"])) == (3, 0, "2022-03-07")
    assert go(spark, tmp_path, refs) == {} and load.read_warehouse(spark, p).count() == 6
    write(inc, "ticket_history_2022-03-05.csv", [row(i, final_price=9.001) for i in range(4)])  # sent again, other content
    again = go(spark, tmp_path, refs)
    assert again["ticket_history_2022-03-05.csv"]["errors"] == [load.RESENT]
    assert go(spark, tmp_path, refs) == {}


def test_customer_file_of_the_same_day_unlocks_tickets(spark, refs, tmp_path):
    inc, p = tmp_path / "incoming", load.Paths(str(tmp_path))
    write(inc, "ticket_history_2022-03-06.csv", [row(0, "2022-03-06", customer_id=77)])
    write(inc, "customer_2022-03-06.csv", [dict(customer_id=77, usergender="Female", dob="1/2/1990"),
                                           dict(customer_id=1, usergender="Female", dob="1990-01-01")], ["usergender", "customer_id", "dob"])
    write(inc, "campaign_2022-03-06.csv", [dict(campaign_id=60, campaign_type="voucher"), dict(campaign_id=60, campaign_type="gift")],
          ["campaign_id", "campaign_type"])
    write(inc, "status_detail_2022-03-07.csv", [dict(status_id=-9, description="x", error_group="bank")], ["status_id", "description", "error_group"])
    out = go(spark, tmp_path, refs)
    assert out["customer_2022-03-06.csv"]["errors"] == [] and out["customer_2022-03-06.csv"]["warnings"] == ["updates_existing"]
    assert out["campaign_2022-03-06.csv"]["errors"] == ["key_conflict"]
    assert out["campaign_2022-03-06.csv"]["warnings"] == ["invalid_campaign_type"]
    assert out["status_detail_2022-03-07.csv"]["errors"] == ["invalid_error_group"]
    assert out["ticket_history_2022-03-06.csv"]["errors"] == []
    assert out["campaign_2022-03-06.csv"]["decision"] == "quarantine"
    assert go(spark, tmp_path, refs)["ticket_history_2022-03-06.csv"]["decision"] == "accept"
    now = {r["customer_id"]: r["usergender"] for r in load.load_refs(spark, p, refs)["customer"].collect()}
    assert now == {1: "Female", 2: "Male", 3: "Male", 77: "Female"}


def test_export_is_split_by_day_and_unreadable_export_is_rejected(spark, refs, tmp_path):
    inc, p = tmp_path / "incoming", load.Paths(str(tmp_path))
    write(inc, "ticket_history_march.csv", [row(0), row(1), row(0, "2022-03-06")])
    out = go(spark, tmp_path, refs)
    assert {f: r["decision"] for f, r in out.items()} == {
        "ticket_history_2022-03-05__ticket_history_march.csv": "accept", "ticket_history_2022-03-06__ticket_history_march.csv": "accept"}
    assert go(spark, tmp_path, refs) == {}
    days = load.read_warehouse(spark, p).groupBy("file_date").count().orderBy("file_date").collect()
    assert [r["count"] for r in days] == [2, 1]
    write(inc, "ticket_history_april.csv", [row(0, "2022-04-01"), row(1, "2022-04-01", time="later")])
    out = go(spark, tmp_path, refs)
    assert out["ticket_history_april.csv"]["errors"] == [load.CANNOT_SPLIT]
    assert load.read_warehouse(spark, p).count() == 3
    assert go(spark, tmp_path, refs) == {}


def test_volume_warning_needs_seven_loads(spark, refs, tmp_path):
    from tillwatch.operators import quality
    inc = tmp_path / "incoming"
    for n in range(1, 9):
        write(inc, f"ticket_history_2022-05-0{n}.csv", [row(i, f"2022-05-0{n}") for i in range(1 if n == 8 else 20)])
    out = go(spark, tmp_path, refs)
    assert out["ticket_history_2022-05-07.csv"]["warnings"] == [] and out["ticket_history_2022-05-08.csv"]["warnings"] == ["volume"]
    log = spark.read.parquet(str(tmp_path / "log/quality"))
    assert [tuple(r) for r in quality.warning_counts(log).collect()] == [("volume", 1)]
    assert quality.log_summary(log).collect()[0]["files"] == 8


def test_until_keeps_later_files_pending(spark, refs, tmp_path):
    inc = tmp_path / "incoming"
    for day in (DAY, "2022-03-06"):
        write(inc, f"ticket_history_{day}.csv", [row(0, day)])
    assert list(go(spark, tmp_path, refs, until=DAY)) == [f"ticket_history_{DAY}.csv"]
    assert list(go(spark, tmp_path, refs)) == ["ticket_history_2022-03-06.csv"]
