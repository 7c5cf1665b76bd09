"""A table of decoded hours that runs add to.

Each run writes a folder of its own, partitioned by instrument and month, and counts from the moment its marker is renamed
into place; a run that failed, or still writes, is never seen. Runs that overlap, because they were started together or an
hour was tried again, do not double anything: of each hour one run counts, the first that finished it, and ticks of the
others are left out.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation

from ..operators.coverage import HOUR_KEY
from ..schemas import FILE_STATUS, RAW_TICKS
from ..session import setting, written
from .archive import DECODED, decode_archive, spread_files

MARKERS = "_published"  # Spark's readers pass over names that begin so
FINISHED = ("ok", "empty")  # hours that need not be opened again
OPEN_FOLDERS = 16  # that a task writes side by side
LISTED = 200  # ranges that a condition names one by one


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def land_run(
    spark: SparkSession, root: str, table: str, files: DataFrame, on_error: str = "skip", partitions: int | None = None
) -> tuple[str, dict]:
    """Decode the files named by rows (instrument, hour, path) into a run of ``table`` that is not published yet.

    Returns the run and its totals, which were observed while the rows were written: hours by status, and ticks.
    """
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:12]}"
    seen = Observation(run)
    status = F.col("status")
    decoded = decode_archive(spread_files(files, partitions, ordered=True), root, on_error).observe(
        seen,
        F.count("status").alias("hours"),
        *[F.count_if(status == name).alias(f"{name}_hours") for name in ("ok", "empty", "no_data")],
        F.count_if(status == "error").alias("skipped_hours"),
        F.count_if(status.isNull()).alias("ticks"),
    )
    rows = decoded.withColumn("month", F.date_format("hour", "yyyy-MM"))
    # A task's files come by instrument and hour, so it writes few folders at a time and its ticks need no sort for that.
    with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(OPEN_FOLDERS)):
        rows.write.partitionBy("instrument", "month").parquet(f"{table}/run={run}")
    return run, seen.get


def publish_run(spark: SparkSession, table: str, run: str) -> None:
    """Let a landed run count, all of it at once."""
    store, marker = _files(spark, f"{table}/{MARKERS}/{run}")
    _, draft = _files(spark, f"{table}/{MARKERS}/.{run}")
    store.mkdirs(marker.getParent())
    store.create(draft, True).close()
    if not store.rename(draft, marker):
        raise RuntimeError(f"run {run} could not be published")


def published_runs(spark: SparkSession, table: str) -> list[str]:
    store, markers = _files(spark, f"{table}/{MARKERS}")
    if not store.exists(markers):
        return []
    names = [status.getPath().getName() for status in store.listStatus(markers)]
    return sorted(name for name in names if not name.startswith("."))


def _rows(spark: SparkSession, table: str) -> DataFrame:
    """Ticks and statuses of the published runs, with ``run`` and ``month``."""
    schema = T.StructType([*DECODED.fields, T.StructField("run", T.StringType()), T.StructField("month", T.StringType())])
    runs = published_runs(spark, table)
    if not runs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*[f"{table}/run={run}" for run in runs])


def _asked(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows inside the ranges. What all ranges have in common reaches the scan: its folders and Parquet's own statistics.

    Few ranges are a condition, which the scan takes whole; many are joined by instrument.
    """
    wanted = ranges.select(F.col("instrument").alias("wanted"), "start_date", "end_date").distinct()
    first, last = wanted.agg(F.min("start_date"), F.max("end_date")).first()
    if first is None:
        return rows.filter("false")
    rows = rows.filter(F.col("month").between(first.strftime("%Y-%m"), last.strftime("%Y-%m")))
    rows = rows.filter(_days(F.lit(first), F.lit(last)))
    some = wanted.limit(LISTED + 1).collect()
    if len(some) > LISTED:
        return rows.join(wanted, (F.col("instrument") == F.col("wanted")) & _days(F.col("start_date"), F.col("end_date")), "left_semi")
    names: dict[tuple, list[str]] = {}
    for row in some:
        names.setdefault((row.start_date, row.end_date), []).append(row.wanted)
    rows = rows.filter(F.col("instrument").isin([row.wanted for row in some]))
    return rows.filter(reduce(Column.__or__, (F.col("instrument").isin(of) & _days(*map(F.lit, ends)) for ends, of in names.items())))


def _days(first: Column, last: Column) -> Column:
    return (F.col("hour") >= first.cast("timestamp")) & (F.col("hour") < F.date_add(last, 1).cast("timestamp"))


def _statuses(rows: DataFrame) -> DataFrame:
    """Of each hour the status in the run that counts: the first that finished it, or else the last that tried."""
    finished = F.col("status").isin(*FINISHED)
    runs = F.struct("run", "path", "status", "n_ticks", "error")
    tried = rows.filter("status is not null").groupBy(*HOUR_KEY)
    one = F.coalesce(F.min_by(runs, F.when(finished, F.col("run"))), F.max_by(runs, "run"))
    return tried.agg(one.alias("one")).select(*HOUR_KEY, "one.*")


def landed_status(spark: SparkSession, table: str, ranges: DataFrame | None = None) -> DataFrame:
    """One row per hour that a published run opened."""
    rows = _rows(spark, table)
    return _statuses(rows if ranges is None else _asked(rows, ranges)).select(*FILE_STATUS.fieldNames())


def landed_ticks(spark: SparkSession, table: str, ranges: DataFrame | None = None) -> DataFrame:
    """Raw ticks, those of an hour from the run that counts for it.

    What is left out are the hours that other runs hold too. They are few, so ticks are not shuffled to find them: they are
    written first, and Spark sees how small they are.
    """
    rows = _rows(spark, table)
    rows = rows if ranges is None else _asked(rows, ranges)
    ticks = rows.filter("status is null")
    held = rows.filter(F.col("status").isin(*FINISHED)).select(*HOUR_KEY, "run", "status")
    twice = held.groupBy(*HOUR_KEY).agg(F.count("*").alias("n"), F.min("run").alias("first")).filter("n > 1")
    others = held.join(twice, HOUR_KEY).filter("run != first and status = 'ok'").select(*HOUR_KEY, "run")
    if len(published_runs(spark, table)) > 1 and not (others := written(others, "overlaps")).isEmpty():
        ticks = ticks.join(others, [*HOUR_KEY, "run"], "left_anti")
    return ticks.select(*RAW_TICKS.fieldNames())
