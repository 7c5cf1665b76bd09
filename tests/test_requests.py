import datetime as dt

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from quotemill import (
    coverage,
    coverage_by_instrument,
    hour_spine,
    instruments,
    manifest,
    overall_progress,
    pending,
    progress,
    requests,
    requests_totals,
    run_totals,
)
from quotemill.schemas import INSTRUMENTS

DAY = dt.date


def registry(spark, **starts):
    return spark.createDataFrame(
        [(n, n, n, n, "forex", 10, None if s is None else at(s)) for n, s in starts.items()], INSTRUMENTS
    )


def ranges(df):
    return rows(df.select("instrument", "start_date", "end_date", "hours_total"))


def test_one_day_has_24_hours(spark):
    one = requests(registry(spark, a="2020-01-01"), DAY(2024, 1, 1), DAY(2024, 1, 1))
    assert one.select("days_total", "hours_total").first() == (1, 24)
    hours = [r[0] for r in hour_spine(one).select(F.col("hour").cast("string")).orderBy("hour").collect()]
    assert len(hours) == 24 and hours[0] == "2024-01-01 00:00:00" and hours[-1] == "2024-01-01 23:00:00"


def test_reversed_range_is_an_error(spark):
    with pytest.raises(ValueError, match="after end date"):
        requests(registry(spark, a="2020-01-01"), DAY(2024, 1, 2), DAY(2024, 1, 1))
    with pytest.raises(Exception, match="after end date"):
        requests(registry(spark, a="2020-01-01"), end=DAY(2019, 1, 1)).collect()
    with pytest.raises(Exception, match="after end date"):
        requests(registry(spark, a="2020-01-01"), end=DAY(2019, 1, 1), clip=False).collect()
    with pytest.raises(ValueError, match="as_of"):
        requests(registry(spark, a="2020-01-01"))
    schema = "instrument string, start_date date, end_date date"
    backwards = spark.createDataFrame([("a", DAY(2024, 1, 2), DAY(2024, 1, 1))], schema)
    with pytest.raises(Exception):
        hour_spine(backwards).collect()


def test_clipping(spark):
    table = registry(spark, old="2010-01-01", new="2024-01-03", later="2024-02-01", unknown=None)
    got = ranges(requests(table, DAY(2024, 1, 1), DAY(2024, 1, 4)))
    assert got == [
        ("new", DAY(2024, 1, 3), DAY(2024, 1, 4), 48),
        ("old", DAY(2024, 1, 1), DAY(2024, 1, 4), 96),
        ("unknown", DAY(2024, 1, 1), DAY(2024, 1, 4), 96),
    ]


def test_default_start(spark):
    table = registry(spark, a="2024-01-02", b="2024-01-04", c=None)
    assert ranges(requests(table, as_of=DAY(2024, 1, 4))) == [
        ("a", DAY(2024, 1, 2), DAY(2024, 1, 4), 72),
        ("b", DAY(2024, 1, 4), DAY(2024, 1, 4), 24),
        ("c", DAY(2024, 1, 2), DAY(2024, 1, 4), 72),
    ]
    assert ranges(requests(registry(spark, c=None), as_of=DAY(2003, 5, 6))) == [("c", DAY(2003, 5, 5), DAY(2003, 5, 6), 48)]


def test_single_instrument_is_not_clipped(spark):
    table = registry(spark, a="2024-01-03", b=None)
    assert ranges(requests(table, DAY(2024, 1, 1), DAY(2024, 1, 1), clip=False)) == [
        ("a", DAY(2024, 1, 1), DAY(2024, 1, 1), 24),
        ("b", DAY(2024, 1, 1), DAY(2024, 1, 1), 24),
    ]
    own = requests(table, as_of=DAY(2024, 1, 3), clip=False)
    assert [r[1] for r in ranges(own)] == [DAY(2024, 1, 3), DAY(2003, 5, 5)]


def test_manifest_uses_the_id(spark):
    one = instruments(spark).filter("lookup_key = 'usaborrowusd'")
    got = manifest(requests(one, DAY(2024, 1, 15), DAY(2024, 1, 15))).orderBy("hour").first()
    assert (got["instrument"], got["path"]) == ("usatechidxusd", "USATECHIDXUSD/2024/00/15/00h_ticks.bi5")


def test_totals_of_given_ranges(spark):
    frame = spark.createDataFrame([(DAY(2024, 2, 28), DAY(2024, 3, 1))], "start_date date, end_date date")
    assert requests_totals(frame).select("days_total", "hours_total").first() == (3, 72)


@pytest.fixture
def covered(spark):
    plan = manifest(requests(registry(spark, a="2020-01-01", b="2020-01-01"), DAY(2024, 1, 1), DAY(2024, 1, 1)))
    landed = spark.createDataFrame(
        [
            ("a", at("2024-01-01 00:00:00"), "ok", 5),
            ("a", at("2024-01-01 01:00:00"), "empty", 0),
            ("a", at("2024-01-01 02:00:00"), "error", 0),
            ("b", at("2024-01-01 00:00:00"), "ok", 7),
            ("b", at("2024-01-02 00:00:00"), "ok", 9),  # not asked for
        ],
        "instrument string, hour timestamp, status string, n_ticks bigint",
    )
    return plan, landed, coverage(plan, landed)


def test_coverage(covered):
    assert rows(coverage_by_instrument(covered[2])) == [("a", 24, 1, 1, 21, 1, 5), ("b", 24, 1, 0, 23, 0, 7)]
    assert rows(run_totals(covered[2])) == [(48, 2, 1, 44, 1, 12)]


def test_hours_are_never_broadcast(covered):
    for frame in (covered[2], pending(covered[0], covered[1])):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_pending(covered):
    plan, landed, _ = covered
    done = landed.filter("status in ('ok', 'empty')")
    assert pending(plan, done).groupBy("instrument").count().orderBy("instrument").collect() == [("a", 22), ("b", 23)]
    absent = plan.filter(F.hour("hour") >= 12)
    assert pending(plan, done, absent).count() == 48 - 3 - 24


@pytest.mark.parametrize("done, percent", [(0, 0.0), (24, 50.0), (48, 100.0)])
def test_progress(spark, done, percent):
    tasks = spark.createDataFrame([("a", done, 48)], "instrument string, hours_completed bigint, hours_total bigint")
    assert overall_progress(tasks).first() == (done, 48, percent)


def test_progress_without_hours(spark):
    schema = "instrument string, hours_completed bigint, hours_total bigint"
    assert overall_progress(spark.createDataFrame([], schema)).first() == (0, 0, 0.0)
    tasks = spark.createDataFrame([("a", 0, 0), ("b", 1, 2), ("b", 1, 2)], schema)
    assert rows(progress(tasks), F.col("instrument").asc_nulls_last()) == [
        ("a", 0, 0, 0.0),
        ("b", 2, 4, 50.0),
        (None, 2, 4, 50.0),
    ]
