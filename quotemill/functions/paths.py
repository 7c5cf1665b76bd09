"""Archive paths: ``INSTRUMENT/year/month-1/day/HHh_ticks.bi5``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICK_BYTES = 20
FILE_SUFFIX = "h_ticks.bi5"

# Four slashes at least, then integers; a plus sign is accepted everywhere and a minus sign in the year.
_PATH = r"(?s)^.*/([+-]?[0-9]+)/(\+?[0-9]+)/(\+?[0-9]+)/(\+?[0-9]+)h_ticks\.bi5$"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def archive_path(instrument: Column | str, hour: Column | str) -> Column:
    """Relative path of an hour's file; months count from zero."""
    hour = _column(hour)

    def two_digits(number: Column) -> Column:
        return F.lpad(number.cast("string"), 2, "0")

    return F.concat_ws(
        "/",
        F.upper(_column(instrument)),
        F.year(hour).cast("string"),
        two_digits(F.month(hour) - 1),
        two_digits(F.day(hour)),
        F.concat(two_digits(F.hour(hour)), F.lit(FILE_SUFFIX)),
    )


def hour_from_path(path: Column | str) -> Column:
    """Hour a path stands for; NULL where the path does not name a valid hour."""
    path = _column(path)

    def part(i: int) -> Column:
        return F.regexp_extract(path, _PATH, i).try_cast("int")

    month = part(2)
    return F.try_make_timestamp(
        part(1),
        F.when(month.between(0, 11), month + 1),
        part(3),
        part(4),
        F.lit(0),
        F.lit(0),
        F.lit("UTC"),
    )


def ticks_in_payload(length: Column | str) -> Column:
    """Whole records in a decompressed payload of ``length`` bytes."""
    return F.call_function("div", _column(length), F.lit(TICK_BYTES)).cast("bigint")
