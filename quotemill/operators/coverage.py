"""Requested hours against landed hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_KEY = ["instrument", "hour"]

# Hours expanded from date ranges look tiny to the planner, whose size estimate does not know how many days a
# range spans. The joins below therefore always merge by key, never broadcast.


def coverage(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with a status (``ok``, ``empty``, ``no_data``, ``error``) and a tick count.

    ``files`` holds one row (instrument, hour, status, n_ticks) per landed file; a requested hour without one
    has no data, which is not an error.
    """
    landed = files.select(*HOUR_KEY, "status", "n_ticks").hint("merge")
    return (
        manifest.join(landed, HOUR_KEY, "left")
        .withColumn("status", F.coalesce("status", F.lit("no_data")))
        .withColumn("n_ticks", F.coalesce("n_ticks", F.lit(0).cast("bigint")))
    )


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("hours"),
        F.count_if(F.col("status") == "ok").alias("ok_hours"),
        F.count_if(F.col("status") == "empty").alias("empty_hours"),
        F.count_if(F.col("status") == "no_data").alias("no_data_hours"),
        F.count_if(F.col("status") == "error").alias("skipped_hours"),
        F.coalesce(F.sum("n_ticks"), F.lit(0)).cast("bigint").alias("ticks"),
    ]


def coverage_by_instrument(covered: DataFrame) -> DataFrame:
    """Hours by status and ticks of each instrument."""
    return covered.groupBy("instrument").agg(*_totals())


def run_totals(covered: DataFrame) -> DataFrame:
    """Hours by status and ticks of a whole run, in one row."""
    return covered.agg(*_totals())


def pending(manifest: DataFrame, done: DataFrame, known_absent: DataFrame | None = None) -> DataFrame:
    """Manifest rows not yet done. ``known_absent`` names hours that have no file upstream."""
    finished = done.select(*HOUR_KEY)
    if known_absent is not None:
        finished = finished.unionByName(known_absent.select(*HOUR_KEY))
    return manifest.join(finished.hint("merge"), HOUR_KEY, "left_anti")


def _progress() -> list[Column]:
    done, total = F.coalesce(F.sum("hours_completed"), F.lit(0)), F.coalesce(F.sum("hours_total"), F.lit(0))
    percent = F.when(total == 0, F.lit(0.0)).otherwise(done.cast("double") / total.cast("double") * F.lit(100.0))
    return [
        done.cast("bigint").alias("hours_completed"),
        total.cast("bigint").alias("hours_total"),
        percent.alias("progress_percent"),
    ]


def progress(tasks: DataFrame) -> DataFrame:
    """Finished share of each instrument, and of everything in a row whose instrument is NULL.

    ``tasks`` has (instrument, hours_completed, hours_total); zero hours count as 0 %.
    """
    return tasks.rollup("instrument").agg(*_progress())


def overall_progress(tasks: DataFrame) -> DataFrame:
    """Finished share of everything; one row also when there are no tasks."""
    return tasks.agg(*_progress())
