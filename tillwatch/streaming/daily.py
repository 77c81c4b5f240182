"""Structured Streaming jobs over the file feed and over attempt streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tillwatch.functions import columns as C
from tillwatch.functions.tables import union_on
from tillwatch.operators.clean import with_status
from tillwatch.plans import load
from tillwatch.schema import ERROR_GROUPS
from tillwatch.session import shared_dir, write_shared
from tillwatch.sources import files as fs
from tillwatch.sources import tpch


def gated_ingest(spark: SparkSession, paths: load.Paths, base_refs: dict[str, DataFrame], checkpoint: str,
                 files_per_batch: int = 1000) -> StreamingQuery:
    """Run the gated load whenever new files arrive.

    The micro-batch says *that* something is new; what has to be done follows from the load state, because files behind
    a blocked one must be looked at again in a later batch, when the source has long moved on. Trailing volumes and ids
    of earlier loads come from the warehouse inside the load.
    """
    arrived = fs.arrivals(spark, paths.at("incoming"), files_per_batch)
    return (
        arrived.writeStream.foreachBatch(lambda _batch, _id: load.run(spark, paths, base_refs) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def daily_ops_stream(attempts: DataFrame, status_table: DataFrame, delay: str = "1 day") -> DataFrame:
    """Operations metrics per day from a stream of attempts. In update mode every day is out as soon as it has rows, in append mode once the
    watermark has passed its end."""
    d = with_status(attempts, status_table).withWatermark("time", delay)
    return d.groupBy(F.window("time", "1 day").alias("w")).agg(
        F.count("*").alias("tickets"), F.count_if("is_success").alias("success"),
        F.round(C.rate("is_success"), 4).alias("success_rate"),
        F.round(F.coalesce(F.sum(F.when(F.col("is_success"), C.money("final_price"))), F.lit(0)), 2).cast("double").alias("revenue"),
        *[F.count_if(F.col("is_failed") & (F.col("error_group") == g)).alias(f"errors_{g}") for g in ERROR_GROUPS],
    ).select(F.to_date("w.start").alias("day"), "tickets", "success", "success_rate", "revenue", *[f"errors_{g}" for g in ERROR_GROUPS])


def without_repeats(attempts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop repeated ticket ids that arrive within the watermark. Rows older than that are dropped too; ``drain_without_repeats`` keeps them."""
    return attempts.withWatermark("time", delay).dropDuplicatesWithinWatermark(["ticket_id"])


def drain_without_repeats(attempts: DataFrame, name: str, delay: str = "1 day", known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, late): every ticket id of the stream once, its earliest row. Nothing is lost: a row more than ``delay`` older than the newest row of the
    batches before goes to the late table, if its id is new.

    Ids are compared with those of all earlier batches and with ``known`` (ticket_id), not only with what a watermark still remembers.
    Every batch has folders of its own, and looks only at earlier ones, so a batch that is repeated writes the same again. Rows without an id are all kept.
    """
    spark = attempts.sparkSession
    schema = T.StructType([*attempts.schema.fields, T.StructField("batch", T.LongType())])
    out, late, marks, checkpoint = (shared_dir(spark, f"{name}-{x}") for x in ("accepted", "late", "newest", "checkpoint"))
    for path in (out, late):
        spark.createDataFrame([], attempts.schema).write.parquet(f"{path}/batch=-1")
    spark.createDataFrame([(None,)], "newest timestamp").write.parquet(f"{marks}/batch=-1")
    rest = [c for c in attempts.columns if c != "time"]

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        seen = [session.read.schema(schema).parquet(p).where(F.col("batch") < number).select("ticket_id") for p in (out, late)]
        seen = union_on([*seen, *([known.select("ticket_id")] if known is not None else [])], "ticket_id")
        newest = session.read.parquet(marks).where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        first = batch.where("ticket_id IS NOT NULL").groupBy("ticket_id").agg(F.min(F.struct("time", *rest)).alias("r")).select("r.*")
        new = first.join(seen, "ticket_id", "left_anti").select(*attempts.columns).unionByName(batch.where("ticket_id IS NULL"))
        new = write_shared(new, f"{name}-new")
        old = F.coalesce(F.col("time") < F.lit(newest).cast("timestamp") - F.expr(f"interval {delay}"), F.lit(False))
        new.where(~old).write.mode("overwrite").parquet(f"{out}/batch={number}")
        new.where(old).write.mode("overwrite").parquet(f"{late}/batch={number}")
        batch.agg(F.max("time").alias("newest")).write.mode("overwrite").parquet(f"{marks}/batch={number}")
    q = attempts.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return tuple(spark.read.schema(schema).parquet(p).drop("batch") for p in (out, late))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, store the result below the shared folder and read it back."""
    spark = stream.sparkSession
    out, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, name: str, key: str) -> DataFrame:
    """Process everything available in update mode; one row per ``key``, the newest. A batch that is repeated writes the same folder again."""
    spark = stream.sparkSession
    out, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
    q = (stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    columns = stream.columns
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    newest = F.max_by(F.struct(*columns), "batch").alias("row")
    return rows.groupBy(key).agg(newest).select("row.*")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of payment attempts."""
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    return tpch.as_attempts(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
