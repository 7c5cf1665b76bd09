"""Hours as ranges: (instrument, first_hour, last_hour), both ends included.

A request over years is one row, and an archive without gaps is one row per instrument, so the account of what is missing is
kept in ranges and only missing hours are ever expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import archive_path

HOUR_SECONDS = 3600


def _number(hour: Column | str) -> Column:
    """An hour as a count of hours."""
    return F.call_function("div", F.unix_seconds(hour), F.lit(HOUR_SECONDS))


def _hour(number: Column) -> Column:
    return F.timestamp_seconds(number * HOUR_SECONDS)


def requested_ranges(ranges: DataFrame) -> DataFrame:
    """Requests by days as ranges of hours, those of one instrument that touch or overlap as one."""
    first = F.col("start_date").cast("timestamp")
    last = F.date_add("end_date", 1).cast("timestamp")
    days = ranges.select("instrument", _number(first).alias("at"), _number(last).alias("end"))
    return _spans(_edges(days, 1, 0), F.col("first_depth") > 0)


def hour_ranges(hours: DataFrame) -> DataFrame:
    """Rows (instrument, hour) as the longest ranges without a gap; repeated hours count once.

    An hour whose neighbour is there as well does not bound a range, so hours are numbered by instrument and day before
    they are put together: the long part of the work is spread over days, and an instrument's task gets its days' pieces.
    """
    numbers = hours.select("instrument", _number("hour").alias("at")).filter("instrument is not null and at is not null").distinct()
    by_day = "PARTITION BY instrument, at div 24 ORDER BY at"
    pieces = numbers.select("instrument", "at", F.expr(f"at - row_number() OVER ({by_day})").alias("island"), F.expr("at div 24").alias("day"))
    pieces = pieces.groupBy("instrument", "day", "island").agg(F.min("at").alias("at"), (F.max("at") + 1).alias("end"))
    return _spans(_edges(pieces, 1, 0), F.col("first_depth") > 0)


def without(ranges: DataFrame, other: DataFrame) -> DataFrame:
    """What the ranges cover and the other ones do not, as ranges."""

    def cut(rows: DataFrame) -> DataFrame:
        return rows.select("instrument", _number("first_hour").alias("at"), (_number("last_hour") + 1).alias("end"))

    edges = _edges(cut(ranges), 1, 0).unionByName(_edges(cut(other), 0, 1))
    return _spans(edges, (F.col("first_depth") > 0) & (F.col("other_depth") == 0))


def _edges(rows: DataFrame, first: int, other: int) -> DataFrame:
    """Each range (at, end) as a step up and a step down in the depth of its side."""
    steps = [F.struct(F.col(name).alias("at"), F.lit(sign * first).alias("first_step"), F.lit(sign * other).alias("other_step")) for name, sign in (("at", 1), ("end", -1))]
    return rows.select("instrument", F.inline(F.array(*steps)))


def _spans(edges: DataFrame, kept: Column) -> DataFrame:
    """The stretches between edges for which ``kept`` holds, neighbours as one: a sweep over each instrument's edges."""
    points = edges.groupBy("instrument", "at").agg(F.sum("first_step").alias("first_step"), F.sum("other_step").alias("other_step"))
    sweep = "OVER (PARTITION BY instrument ORDER BY at)"
    depths = points.select(
        "instrument", "at", F.expr(f"sum(first_step) {sweep}").alias("first_depth"), F.expr(f"sum(other_step) {sweep}").alias("other_depth")
    )
    turns = depths.withColumn("kept", kept).withColumn("before", F.expr(f"coalesce(lag(kept) {sweep}, false)")).filter("kept != before")
    # Now rows that begin a stretch and rows that end it take turns.
    ends = turns.withColumn("end", F.expr(f"lead(at) {sweep}")).filter("kept")
    return ends.select("instrument", _hour(F.col("at")).alias("first_hour"), _hour(F.col("end") - 1).alias("last_hour"))


def expand(ranges: DataFrame) -> DataFrame:
    """Archive files of the hours in the ranges: (instrument, hour, path). A row never holds more than a range's days."""
    first, last = _number("first_hour"), _number("last_hour")
    days = ranges.select(
        "instrument", first.alias("first"), last.alias("last"), F.explode(F.sequence(F.expr("unix_date(to_date(first_hour))"), F.expr("unix_date(to_date(last_hour))"))).alias("day")
    )
    number = F.col("day").cast("bigint") * 24 + F.col("h")
    hours = days.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23)))).filter(number.between(F.col("first"), F.col("last")))
    return hours.select("instrument", _hour(number).alias("hour")).withColumn("path", archive_path("instrument", "hour"))


def pending_ranges(ranges: DataFrame, done: DataFrame, known_absent: DataFrame | None = None) -> DataFrame:
    """Ranges of requested hours that are not done. ``known_absent`` names hours that have no file upstream."""
    finished = done.select("instrument", "hour")
    if known_absent is not None:
        finished = finished.unionByName(known_absent.select("instrument", "hour"))
    return without(requested_ranges(ranges), hour_ranges(finished))


def missing_hours(ranges: DataFrame, done: DataFrame) -> DataFrame:
    """The requested hours that are not done, as rows (instrument, hour, path)."""
    return expand(pending_ranges(ranges, done))
