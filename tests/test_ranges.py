"""Hours as ranges against sets of hours."""

import datetime as dt
import random

from helpers import at, rows

from quotemill import expand, hour_ranges, manifest, missing_hours, pending, pending_ranges, requested_ranges, without

HOURS = "instrument string, hour timestamp"
RANGES = "instrument string, first_hour timestamp, last_hour timestamp"
DAYS = "instrument string, start_date date, end_date date"


def hour(n):
    return (dt.datetime(2023, 12, 30) + dt.timedelta(hours=n)).replace(tzinfo=dt.timezone.utc)


def some_hours(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice("abc"), rng.randrange(-30, 260)) for _ in range(n)]


def islands(hours):
    out = []
    for name, n in sorted(set(hours)):
        if out and out[-1][0] == name and out[-1][2] == n - 1:
            out[-1][2] = n
        else:
            out.append([name, n, n])
    return [(name, hour(a).replace(tzinfo=None), hour(b).replace(tzinfo=None)) for name, a, b in out]


def frame(spark, hours):
    return spark.createDataFrame([(name, hour(n)) for name, n in hours], HOURS)


def test_hours_make_the_longest_ranges(spark):
    hours = some_hours(1) + [("d", 24), ("d", 23), ("d", 24), ("e", 0)]
    got = hour_ranges(frame(spark, hours).union(spark.createDataFrame([(None, hour(1)), ("a", None)], HOURS)))
    assert rows(got) == islands(hours)
    assert rows(hour_ranges(frame(spark, []))) == []


def test_difference_of_ranges_is_that_of_their_hours(spark):
    first, other = some_hours(2), some_hours(3, 250) + [("z", 1)]
    got = without(hour_ranges(frame(spark, first)), hour_ranges(frame(spark, other)))
    assert rows(got) == islands(set(first) - set(other))


def test_ranges_that_overlap_or_touch(spark):
    some = [("a", 0, 10), ("a", 5, 20), ("a", 21, 22), ("a", 24, 24), ("a", 3, 4), ("b", 7, 7)]
    ranges = spark.createDataFrame([(n, hour(x), hour(y)) for n, x, y in some], RANGES)
    none = spark.createDataFrame([], RANGES)
    covered = [(n, h) for n, x, y in some for h in range(x, y + 1)]
    assert rows(without(ranges, none)) == islands(covered)
    assert rows(without(none, ranges)) == rows(without(ranges, ranges)) == []


def test_expanded_ranges_name_their_files(spark):
    hours = some_hours(4)
    ranges = hour_ranges(frame(spark, hours))
    got = expand(ranges)
    assert [(a, b) for a, b, _ in rows(got)] == [(name, hour(n).replace(tzinfo=None)) for name, n in sorted(set(hours))]
    one = expand(spark.createDataFrame([("eurusd", at("2024-01-15 12:00:00"), at("2024-01-15 12:00:00"))], RANGES)).first()
    assert one.path == "EURUSD/2024/00/15/12h_ticks.bi5"


def test_pending_by_ranges_equals_pending_by_hours(spark):
    days = [("a", dt.date(2023, 12, 29), dt.date(2024, 1, 3)), ("a", dt.date(2024, 1, 2), dt.date(2024, 1, 5)), ("q", dt.date(2024, 1, 1), dt.date(2024, 1, 1))]
    asked = spark.createDataFrame(days, DAYS)
    done, absent = frame(spark, some_hours(5)), frame(spark, some_hours(6, 60))
    # Ranges that overlap repeat their hours in a manifest; as ranges they count once.
    assert rows(expand(pending_ranges(asked, done, absent))) == sorted(set(rows(pending(manifest(asked), done, absent))))
    assert rows(missing_hours(asked, done)) == sorted(set(rows(pending(manifest(asked), done))))


def test_a_long_history_stays_a_few_rows(spark):
    asked = spark.createDataFrame([(f"i{n}", dt.date(2003, 5, 5), dt.date(2024, 1, 1)) for n in range(44)], DAYS)
    done = asked.selectExpr("instrument", "timestamp '2010-01-01 05:00:00' AS hour")
    assert requested_ranges(asked).count() == 44
    assert pending_ranges(asked, done).count() == 88
