"""Timeframes, bar starts and date ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Timeframe names, their width in seconds (None = no bucketing) and accepted aliases.
TIMEFRAMES = {
    "tick": (None, ()),
    "s1": (1, ("1s", "second", "second1")),
    "m1": (60, ("1m", "minute", "minute1")),
    "m5": (300, ("5m", "minute5")),
    "m15": (900, ("15m", "minute15")),
    "m30": (1800, ("30m", "minute30")),
    "h1": (3600, ("1h", "hour", "hour1")),
    "h4": (14400, ("4h", "hour4")),
    "d1": (86400, ("1d", "day", "day1", "daily")),
}


def parse_timeframe(name: str) -> str:
    """Canonical timeframe name for a name or alias, in any case."""
    wanted = name.lower()
    for canonical, (_, aliases) in TIMEFRAMES.items():
        if wanted == canonical or wanted in aliases:
            return canonical
    raise ValueError(f"invalid timeframe {name!r}, expected one of: {', '.join(TIMEFRAMES)}")


def timeframe_seconds(name: str) -> int | None:
    """Width of a timeframe in seconds; None for single ticks."""
    return TIMEFRAMES[parse_timeframe(name)][0]


def bar_start(ts: Column | str, timeframe: str) -> Column:
    """Start of the UTC-aligned bar that holds ``ts``; the time itself for the tick timeframe.

    Every width divides a day, so flooring the epoch gives the same as truncating clock fields, and it does
    not depend on the session time zone.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = timeframe_seconds(timeframe)
    if seconds is None:
        return ts
    ms = F.unix_millis(ts)
    return F.timestamp_millis(ms - F.pmod(ms, F.lit(seconds * 1000)))


def in_range(ts: Column | str, start: dt.date, end: dt.date) -> Column:
    """Whether the day of ``ts`` lies in [start, end], as a half-open range that a scan can push down."""
    if start > end:
        raise ValueError(f"start date {start} is after end date {end}")
    ts = F.col(ts) if isinstance(ts, str) else ts
    return (ts >= F.lit(start)) & (ts < F.lit(end + dt.timedelta(days=1)))
