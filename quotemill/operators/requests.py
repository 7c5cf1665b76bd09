"""Requested date ranges and the archive hours they need."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import archive_path

# Fixed value: first day of a request when no instrument names one.
DEFAULT_START = dt.date(2003, 5, 5)


def requests_totals(ranges: DataFrame) -> DataFrame:
    """Add day and hour totals to (instrument, start_date, end_date); both ends count."""
    days = F.date_diff("end_date", "start_date").cast("bigint") + 1
    return ranges.withColumn("days_total", days).withColumn("hours_total", F.col("days_total") * 24)


def _checked(start: Column, end: Column) -> Column:
    message = F.concat(F.lit("start date "), start.cast("string"), F.lit(" is after end date "), end.cast("string"))
    return F.when(start <= end, start).otherwise(F.raise_error(message).cast("date"))


def requests(
    instruments: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    as_of: dt.date | None = None,
    clip: bool = True,
) -> DataFrame:
    """One requested range per instrument: (instrument, start_date, end_date, days_total, hours_total).

    The end defaults to ``as_of``. With ``clip``, the start defaults to the earliest first day among the
    instruments, each range starts no earlier than its instrument's first day, and instruments that start
    after the end are left out. Without it, the start defaults to each instrument's own first day, a given
    start is taken as it is, and a range that ends before it starts is an error.
    """
    last = end or as_of
    if last is None:
        raise ValueError("give an end date or an as_of date")
    if start is not None and start > last:
        raise ValueError(f"start date {start} is after end date {last}")

    end_date = F.lit(last)
    own = F.to_date("start_tick_date")
    base = instruments.select(F.col("id").alias("instrument"), own.alias("own_start"))
    if clip:
        if start is None:
            earliest = instruments.agg(F.min(own)).scalar()
            first = _checked(F.coalesce(earliest, F.lit(DEFAULT_START)), end_date)
        else:
            first = F.lit(start)
        # greatest() skips a NULL first day, which means: no clipping.
        ranges = base.withColumn("start_date", F.greatest(first, F.col("own_start"))).filter(
            F.col("start_date") <= end_date
        )
    else:
        first = F.lit(start) if start else F.coalesce(F.col("own_start"), F.lit(DEFAULT_START))
        ranges = base.withColumn("start_date", _checked(first, end_date))
    return requests_totals(ranges.withColumn("end_date", end_date).select("instrument", "start_date", "end_date"))


def hour_spine(ranges: DataFrame) -> DataFrame:
    """Every hour from 00:00 of the start date to 23:00 of the end date; other columns stay.

    Days are expanded first, so no row ever holds more than a day count and 24 hours.
    """
    kept = [c for c in ranges.columns if c not in ("start_date", "end_date", "days_total", "hours_total")]
    days = ranges.select(*kept, F.explode(F.sequence("start_date", "end_date", F.expr("interval 1 day"))).alias("day"))
    midnight = F.unix_seconds(F.col("day").cast("timestamp"))
    hours = days.select(*kept, midnight.alias("midnight"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    return hours.select(*kept, F.timestamp_seconds(F.col("midnight") + F.col("h") * 3600).alias("hour"))


def manifest(ranges: DataFrame) -> DataFrame:
    """Requested archive files: (instrument, hour, path).

    A range that several keys of one instrument ask for counts once, and the shuffle for that spreads the ranges.
    """
    return hour_spine(ranges.select("instrument", "start_date", "end_date").distinct()).withColumn(
        "path", archive_path("instrument", "hour")
    )
