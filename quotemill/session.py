"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Archive hours and bar starts are UTC clock fields, and the Parquet sink stores microsecond timestamps.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to an existing session and return it."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting for the jobs of a block."""
    given = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, given)


def tune_for_small_files(spark: SparkSession) -> None:
    """Settings for scans of many small files, where they still have Spark's own values.

    An opened file counts as 64 KB, not 4 MB, so a task gets hundreds of hour files, and a listing of many
    paths is shared by a few tasks per core instead of one task per path.
    """
    spread = str(max(32, 4 * spark.sparkContext.defaultParallelism))
    for key, stock, value in (
        ("spark.sql.files.openCostInBytes", ("4194304", "4194304b", "4MB"), "65536"),
        ("spark.sql.sources.parallelPartitionDiscovery.parallelism", ("10000",), spread),
    ):
        if spark.conf.get(key) in stock:
            spark.conf.set(key, value)


def task_width(spark: SparkSession) -> int:
    """Tasks to share out work whose rows say nothing of its cost, such as directories to list.

    That is the number of shuffle partitions, but in a local session two per core at most.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    context = spark.sparkContext
    return min(width, 2 * context.defaultParallelism) if context.master.startswith("local") else width


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quotemill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session may run without that setting; it then gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quotemill-")
    return os.path.join(base, f"quotemill-{purpose}-{uuid.uuid4().hex}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in a fresh folder of the shared one, for work that reads them more than once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
