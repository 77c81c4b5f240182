"""Marts, dictionary, weekly bundle, base tables and the streamed load."""

import datetime as dt
import os

import pandas as pd
import pytest
from paths import SF
from pyspark.sql import functions as F
from test_load import COLUMNS, refs, row, write  # noqa: F401

from tillwatch.operators import profile
from tillwatch.plans import catalog, load, marts
from tillwatch.plans import weekly as weekly_plan
from tillwatch.schema import TICKETS
from tillwatch.sources import tables, tpch
from tillwatch.streaming import daily


def test_mart_export_checks_keys(spark, tickets, tmp_path):
    good = {"campaign_summary": marts.campaign_summary(tickets, tpch.campaign(spark, SF))}
    marts.export(good, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/campaign_summary.parquet").count() == good["campaign_summary"].count()
    with pytest.raises(ValueError, match="dim_customer"):
        marts.export({"dim_customer": tickets.select("customer_id")}, str(tmp_path))


def test_dictionary_agrees_with_pandas(spark, tickets):
    small = tickets.select("ticket_id", "paying_method", "movie_name", "original_price", "time", "age")
    small = small.withColumn("movie_name", F.when(F.col("age") > 40, F.col("movie_name")))
    got = {r["column"]: r for r in profile.data_dictionary({"t": small}, {"age": "Age in years"}).collect()}
    want = small.toPandas()
    for c in small.columns:
        assert got[c]["n_unique"] == want[c].nunique() and got[c]["null_rate"] == round(float(want[c].isna().mean()), 4)
    assert float(got["original_price"]["min"]) == want["original_price"].min() and got["age"]["description"] == "Age in years"
    assert got["paying_method"]["min"] is None and got["paying_method"]["examples"] == ", ".join(sorted(want["paying_method"].unique())[:3])


def test_weekly_bundle(spark, tickets, tmp_path):
    week = F.to_timestamp(F.lit("2000-06-05"))
    out = weekly_plan.build(tickets, week, min_tickets=1)
    facts = out["weekly_facts"].collect()
    assert len(facts) == 1 and str(facts[0]["week"]).startswith("2000-06-05")
    assert out["marketing_targets"].count() > 100 and out["kpis_monthly"].count() == 0  # below 500 attempts a month
    weekly_plan.export({k: out[k] for k in ("recovery_list", "product_breakdown")}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/recovery_list").count() == out["recovery_list"].count()


def test_fact_from_csv_and_from_warehouse(spark, refs, tmp_path):  # noqa: F811
    base = tmp_path / "base"
    write(base, "ticket_history.csv", [row(i) for i in range(4)], COLUMNS[::-1])
    for name, df in refs.items():
        df.toPandas().to_csv(base / f"{name}.csv", index=False)
    history = tables.load_tickets(spark, str(base))
    assert history.count() == 4 and history.where("is_success AND platform = 'mobile'").count() == 4
    write(tmp_path / "incoming", "ticket_history_2022-03-05.csv", [row(i) for i in range(3)])
    write(tmp_path / "incoming", "customer_2022-03-05.csv", [dict(customer_id=1, usergender="Female", dob="1990-01-01")],
          ["customer_id", "usergender", "dob"])
    paths = load.Paths(str(tmp_path))
    load.require_clean(load.run(spark, paths, {k: v for k, v in tables.load_raw(spark, str(base)).items() if k != TICKETS}))
    loaded = tables.load_tickets(spark, str(base), paths)
    assert loaded.count() == 3 and {r["usergender"] for r in loaded.where("customer_id = 1").collect()} == {"Female"}


def test_streamed_load_equals_batch_load(spark, refs, tmp_path):  # noqa: F811
    for side in ("batch", "stream"):
        inc = tmp_path / side / "incoming"
        write(inc, "ticket_history_2022-03-05.csv", [row(i) for i in range(4)])
        write(inc, "ticket_history_2022-03-06.csv", [row(0, "2022-03-06", status_id=99)])
        write(inc, "ticket_history_2022-03-07.csv", [row(0, "2022-03-07")])
    batch, stream = (load.Paths(str(tmp_path / s)) for s in ("batch", "stream"))
    load.run(spark, batch, refs)
    go = lambda: daily.gated_ingest(spark, stream, refs, str(tmp_path / "checkpoint")).awaitTermination()
    go()
    same = lambda p: sorted(map(tuple, load.read_state(spark, p).select("file", "status").collect()))
    assert same(batch) == same(stream) and len(same(stream)) == 2
    assert load.read_warehouse(spark, stream).count() == 4
    write(tmp_path / "stream" / "incoming", "ticket_history_2022-03-06__fixed.csv", [row(0, "2022-03-06")])
    go()  # the new file also brings back the one that waited behind the blocked file
    assert load.read_warehouse(spark, stream).count() == 6


def test_stream_drops_repeated_ids(spark):
    s = daily.event_stream(spark, SF)
    twice = s.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    out = daily.drain(daily.without_repeats(twice), "test-repeats")
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_type IN ('purchase', 'error')")
    assert out.count() == events.count() == out.select("ticket_id").distinct().count()
    assert isinstance(out.limit(1).toPandas(), pd.DataFrame)


def test_late_rows_of_a_stream_are_kept_apart(spark, tmp_path):
    at = lambda day, hour=10: dt.datetime(2022, 3, day, hour)
    batches = [[("a", at(5), 1.0), ("a", at(5, 9), 2.0), ("b", at(6), 3.0), (None, at(6), 9.0)],
               [("c", at(9), 4.0), ("b", at(6), 5.0), (None, at(9), 9.5)],
               [("d", at(7), 6.0), ("e", at(9, 8), 7.0), ("a", at(5), 8.0), ("k", at(9), 1.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, "ticket_id string, time timestamp, final_price double").coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        part = next((tmp_path / f"in{n}").glob("part-*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_600_000_000 + n * 60,) * 2)
    stream = spark.readStream.schema("ticket_id string, time timestamp, final_price double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accepted, late = daily.drain_without_repeats(stream, "test-late", known=spark.createDataFrame([("k",)], "ticket_id string"))
    named = lambda df: sorted((r["ticket_id"] or "-", r["final_price"]) for r in df.collect())
    assert named(accepted) == [("-", 9.0), ("-", 9.5), ("a", 2.0), ("b", 3.0), ("c", 4.0), ("e", 7.0)]
    assert named(late) == [("d", 6.0)]


def test_a_model_is_fitted_once_for_the_same_rows(spark, monkeypatch):
    from tillwatch.plans import models
    rows = spark.createDataFrame([(i % 7, float(i % 3), i % 2) for i in range(200)], "a int, b double, y int")
    fits = []
    train = models.train
    monkeypatch.setattr(models, "train", lambda *a, **kw: (fits.append(1), train(*a, **kw))[1])
    name = f"test-{pd.Timestamp.now().value}"
    one, two = (models.fitted(r, [], ["a", "b"], "y", name, trees=2) for r in (rows, rows.repartition(3)))
    assert len(fits) == 1 and one.stages[-1].totalNumNodes == two.stages[-1].totalNumNodes
    models.fitted(rows.where("a < 6"), [], ["a", "b"], "y", name, trees=2)
    assert len(fits) == 2


def test_a_category_may_have_many_values(spark):
    from tillwatch.plans import models
    rows = spark.createDataFrame([(f"v{i % 90}", float(i % 5), i % 2) for i in range(400)], "c string, b double, y int")
    model = models.train(rows, ["c"], ["b"], "y", trees=1)
    assert models.score(model, rows, ["b"], ["c"]).count() == 400


def test_customer_mart_carries_the_model_score(spark, tickets):
    from tillwatch.plans import models
    end = marts.day_after(tickets)
    targets = {r["customer_id"]: (r["score"], r["score_source"]) for r in models.target_list(tickets, end).collect()}
    mart = marts.customer_features(tickets, end, models.target_list(tickets, end)).collect()
    assert {r["customer_id"]: (r["repurchase_score"], r["score_source"]) for r in mart} == targets
    got = {r["score_source"]: r for r in models.repurchase_metrics(tickets, end).collect()}
    assert "rule: recency" in got and all(0 <= r["auc"] <= 1 and r["n_top"] > 0 for r in got.values())


def test_the_fact_is_joined_once(spark):
    """Queries that read the fact many times read a stored copy."""
    assert not [f for f in catalog.QUERIES["training_set"](spark, SF).inputFiles() if "lineitem" in f]


def test_delivered_files_are_read_where_they_lie(spark, monkeypatch):
    calls, history = [], catalog.tpch.ticket_history
    monkeypatch.setattr(catalog.tpch, "ticket_history", lambda *a: calls.append(a) or history(*a))
    kinds = lambda: sum(1 for _ in calls)
    catalog._ticket_checks(spark, SF)
    assert kinds() == 2  # the delivery, and the raw tables whose reference part is used
    files = {f.split("/")[-2].rsplit("-", 1)[0] for f in catalog._load_decision(spark, SF).inputFiles()}
    assert files == {"summaries"}
