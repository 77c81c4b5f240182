"""CSV records over byte ranges against Python's own reader; a load that dies before its commit."""

import csv
import io
import random

import pytest
from test_load import COLUMNS, go, refs, row, write  # noqa: F401

from tillwatch.plans import load
from tillwatch.sources import csvlines


@pytest.fixture
def tiny_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "150")
    spark.conf.set(names[1], "0")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def read(spark, folder):
    found: dict = {}
    for r in sorted(csvlines.records(spark, [str(folder)]).collect(), key=lambda r: (r["file"], tuple(r["line"]))):
        found.setdefault(r["file"], []).append(r["values"])
    return found


def test_records_equal_the_csv_module_over_many_ranges(spark, tiny_ranges, tmp_path):
    rnd = random.Random(6)
    bits = ["a", "bc", ",", "\n", '"', '""', " ", "é", "", "x\ny", "1,2", '","']
    want = {}
    for f in range(6):
        rows = []
        for _ in range(60):
            cells = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 4))) if f % 3 else rnd.choice(["a", "b c", "", "7.5"]) for _ in range(rnd.randint(1, 5))]
            rows.append(cells if any(cells) else ["z"])
        out = io.StringIO()
        csv.writer(out, lineterminator="\r\n" if f == 4 else "\n", quoting=csv.QUOTE_ALL if f == 5 else csv.QUOTE_MINIMAL).writerows(rows)
        (tmp_path / f"f{f}.csv").write_bytes(out.getvalue().encode())
        want[f"f{f}.csv"] = rows
    assert read(spark, tmp_path) == want


def test_odd_quotes_blank_lines_and_endings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,size\r\n\n1,5" screen\n\r\n2,"x"y\n3,"open\nto the end'.encode())
    (tmp_path / "b.csv").write_bytes(b"one")
    (tmp_path / "c.csv").write_bytes(b"")
    assert read(spark, tmp_path) == {"a.csv": [["id", "size"], ["1", '5" screen'], ["2", "xy"], ["3", '"open\nto the end']], "b.csv": [["one"]]}


def test_a_large_file_is_read_by_many_tasks(spark, tiny_ranges, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f"{i},text {i}\n" for i in range(500)))
    df = csvlines.records(spark, [str(tmp_path)])
    assert df.select("line.block").distinct().count() > 20 and df.count() == 500


def test_a_load_that_dies_before_its_commit_is_repeated_once(spark, refs, tmp_path, monkeypatch):  # noqa: F811
    p = load.Paths(str(tmp_path))
    write(tmp_path / "incoming", "ticket_history_2022-03-05.csv", [row(i) for i in range(4)])
    write(tmp_path / "incoming", "ticket_history_2022-03-06.csv", [row(0, "2022-03-06", status_id=99)])
    write(tmp_path / "incoming", "notes.csv", [row(0)])

    def dies(*args):
        raise OSError("the machine is gone")
    with monkeypatch.context() as m:
        m.setattr(load, "_write_state", dies)
        with pytest.raises(OSError):
            go(spark, tmp_path, refs)
    go(spark, tmp_path, refs)
    assert load.read_warehouse(spark, p).count() == 4
    assert sorted(r["file"] for r in load.read_quality_log(spark, p).collect()) == ["ticket_history_2022-03-05.csv", "ticket_history_2022-03-06.csv"]
    assert load.read_check_log(spark, p).count() == 2 and load.read_quarantine(spark, p).count() == 1 and load.read_daily_ops(spark, p).count() == 1
    assert [r["file"] for r in load.unrecognized_files(spark, p).collect()] == ["notes.csv"]
    assert load.status(spark, p).first()["unrecognized_files"] == 1
