"""Time the headline queries and the full daily load; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). The cleaned fact is stored once ("store_fact"), as
a job that makes many reports does; the report queries then read it. The load takes one CSV file per day, all of them
new, through the quality gate into an empty warehouse; writing the CSV files is not timed.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINES = [
    "failure_rate_by_method", "first_attempts", "lost_summary", "weekly_error_rates", "recovery_rate_7d", "next_success_gap",
    "monthly_kpis", "monthly_losses", "rfm_segments", "training_set", "campaign_effectiveness", "cohort_retention",
    "buyer_value", "recovered_vs_never", "movie_summary", "weekly_alerts", "weekly_facts", "breakdown_changes", "recovery_list",
    "fact_payment_attempts", "dim_customer", "campaign_summary", "data_dictionary", "point_in_time_features", "rule_capture",
    "gold_q04", "gold_q11", "dq_ticket_checks", "daily_ops", "stream_daily_ops", "passages", "tfidf_top_k", "vector_top_k",
    "ungrounded_numbers",
]


def daily_files(spark, folder: str) -> int:
    """One CSV file per day of the ticket history."""
    from pyspark.sql import functions as F

    from tillwatch.sources import tpch
    t = tpch.ticket_history(spark, SF_DIR).withColumn("day", F.date_format("time", "yyyy-MM-dd")).withColumn("time", F.col("time").cast("string"))
    t.repartition("day").write.partitionBy("day").option("header", True).csv(f"{folder}-parts")
    os.makedirs(folder)
    parts = sorted(Path(f"{folder}-parts").glob("day=*/part-*.csv"))
    for part in parts:
        part.rename(f"{folder}/ticket_history_{part.parent.name[4:]}.csv")
    return len(parts)


def main() -> None:
    from tillwatch.plans import facts, load
    from tillwatch.plans.catalog import QUERIES
    from tillwatch.session import local_session
    from tillwatch.sources import tpch

    spark = local_session(CPUS, "bench")
    times = {}

    def timed(name, f):
        start = time.time()
        f()
        times[name] = round(time.time() - start, 3)

    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    timed("store_fact", lambda: facts.store_tickets(spark, SF_DIR))
    for name in HEADLINES:
        timed(name, lambda: QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    files = daily_files(spark, f"{root}/incoming")
    refs = {k: v for k, v in tpch.raw_tables(spark, SF_DIR).items() if k != "ticket_history"}
    timed("daily_load", lambda: load.run(spark, load.Paths(root), refs))
    loaded = load.read_warehouse(spark, load.Paths(root)).count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(SF_DIR).name,
        "cpus": CPUS, "daily_load_files": files, "daily_load_rows": loaded,
        "daily_load_rows_per_sec": round(loaded / times["daily_load"])}))


if __name__ == "__main__":
    main()
