"""Whole runs: requested hours of an archive to files of ticks or bars."""

from __future__ import annotations

import datetime as dt
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import parse_timeframe
from ..operators.coverage import coverage_by_instrument
from ..operators.instruments import by_category, get_instrument
from ..operators.normalize import normalize_ticks
from ..operators.ohlcv import ohlcv
from ..operators.ranges import missing_hours
from ..operators.requests import requests
from ..session import configure, shared_dir, written
from ..sinks.writers import parse_format, write_bars, write_ticks
from ..sources.registry import instruments as shipped_instruments
from ..sources.run_table import FINISHED, land_run, landed_status, landed_ticks, publish_run


def _check_output(spark: SparkSession, out: str, sink_options: dict) -> None:
    """Raise for what the writer would refuse only after everything was decoded."""
    unknown = sink_options.keys() - inspect.signature(write_bars).parameters.keys()
    if unknown:
        raise TypeError(f"unknown sink options: {', '.join(sorted(unknown))}")
    if sink_options.get("mode", "errorifexists") in ("error", "errorifexists"):
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            raise ValueError(f"output path exists: {out}")


def _resume(spark: SparkSession, root: str, table: str, on_error: str, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add the hours that the table lacks to it, and give the ticks and statuses of the requested hours.

    An hour is finished once it was read; hours without a file and faulty ones are tried again. Only the ranges that are
    missing become hours.
    """
    ranges = written(ranges, "ranges")
    finished = landed_status(spark, table, ranges).filter(F.col("status").isin(*FINISHED))
    todo = written(missing_hours(ranges, finished), "missing")  # counted, sampled and dealt out
    run, _ = land_run(spark, root, table, todo, on_error)
    publish_run(spark, table, run)
    statuses = landed_status(spark, table, ranges)
    return landed_ticks(spark, table, ranges), statuses


def _run(
    spark: SparkSession,
    root: str,
    out: str,
    selected: DataFrame,
    ranges: DataFrame,
    timeframe: str,
    format: str,
    on_error: str,
    table: str | None,
    sink_options: dict,
) -> DataFrame:
    """Land the hours once, write ticks or bars from there, and return the totals per instrument."""
    timeframe = parse_timeframe(timeframe)
    parse_format(format)
    _check_output(spark, out, sink_options)
    raw, statuses = _resume(spark, root, table or shared_dir(spark, "landed"), on_error, ranges)
    ticks = normalize_ticks(raw, selected)
    if timeframe == "tick":
        write_ticks(ticks, out, format, **sink_options)
    else:
        write_bars(ohlcv(ticks, timeframe), out, format, **sink_options)
    return coverage_by_instrument(statuses)


def download(
    spark: SparkSession,
    root: str,
    key: str,
    out: str,
    *,
    start: dt.date | None = None,
    end: dt.date | None = None,
    as_of: dt.date | None = None,
    timeframe: str = "tick",
    format: str = "csv",
    on_error: str = "skip",
    instruments: DataFrame | None = None,
    table: str | None = None,
    **sink_options,
) -> DataFrame:
    """Ticks or bars of one instrument, in time order; returns its hours by status and its tick count.

    ``table`` is as for ``download_all``.
    """
    configure(spark)
    selected = get_instrument(shipped_instruments(spark) if instruments is None else instruments, key)
    if selected.isEmpty():
        raise ValueError(f"unknown instrument: {key}")
    ranges = requests(selected, start, end, as_of, clip=False)
    sink_options = {"partition_by_instrument": False, "ordered": True, **sink_options}
    return _run(spark, root, out, selected, ranges, timeframe, format, on_error, table, sink_options)


def download_all(
    spark: SparkSession,
    root: str,
    out: str,
    *,
    category: str | None = None,
    start: dt.date | None = None,
    end: dt.date | None = None,
    as_of: dt.date | None = None,
    timeframe: str = "tick",
    format: str = "csv",
    on_error: str = "skip",
    instruments: DataFrame | None = None,
    table: str | None = None,
    **sink_options,
) -> DataFrame:
    """Ticks or bars of all instruments, or of a category, in one job with one output folder each.

    Returns the hours by status and the ticks of each instrument, faulty hours included. ``table`` names the
    folder that decoded hours are kept in: a later run with the same one opens only the hours that it lacks, and
    writes the same as a run from the start. Without it they go to a new folder in the shared one.
    """
    configure(spark)
    selected = shipped_instruments(spark) if instruments is None else instruments
    if category is not None:
        selected = by_category(selected, category)
    if selected.isEmpty():
        raise ValueError("no instruments found matching criteria")
    ranges = requests(selected, start, end, as_of, clip=True)
    return _run(spark, root, out, selected, ranges, timeframe, format, on_error, table, sink_options)
