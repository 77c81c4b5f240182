"""Session defaults and the shared folder for data that must outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Settings of ``sparing``.
SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def local_session(cpus: int = 8, app: str = "tillwatch") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    Only where no folder is configured (a local test run) is a temporary one made.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="run-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def write_shared(df, name: str, partition_by: list[str] | None = None):
    """Write a DataFrame to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_home(spark: SparkSession, name: str) -> str:
    """A lasting path below the shared folder, the same for every session that uses the folder."""
    return f"{shared_dir(spark, name).rsplit('/', 1)[0]}/{name}"


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """What is stored meanwhile takes less disk: files are compressed by zstd, and a query's shuffle files go as soon as its result is stored, not when
    the driver happens to collect its garbage."""
    before = {k: spark.conf.get(k, None) for k in SPARING}
    try:
        for k, v in SPARING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drop_shared(df: DataFrame) -> None:
    """Delete a table of ``write_shared`` that nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
