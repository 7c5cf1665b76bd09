import datetime as dt

import pytest
from helpers import at, rows

from quotemill import category_stats, estimate, estimate_batch, estimate_lookbacks, peak_stats
from quotemill.schemas import CATEGORY_STATS, INSTRUMENTS

DAY = dt.date(2024, 1, 1)


def table(spark, *categories, start="2020-01-01"):
    return spark.createDataFrame(
        [(f"i{n}", f"i{n}", "", "", c, 10, start and at(start)) for n, c in enumerate(categories)], INSTRUMENTS
    )


def one_range(spark, start=DAY, end=DAY):
    return spark.createDataFrame([("i0", start, end)], "instrument string, start_date date, end_date date")


def test_single(spark):
    got = estimate(one_range(spark), table(spark, "forex"), category_stats(spark)).first()
    assert (got["total_hours"], got["compressed_bytes"], got["ticks"], got["confidence"]) == (24, 1_800_000, 120_000, "high")
    assert got["uncompressed_bytes"] == got["output_bytes"] == 18_000_000
    assert got["duration_seconds"] == 1_800_000 / (10.0 * 1_000_000.0 / 8.0)


def test_unknown_category_gets_the_defaults(spark):
    got = estimate(one_range(spark), table(spark, "other"), category_stats(spark), mbps=20.0).first()
    assert (got["compressed_bytes"], got["ticks"], got["confidence"]) == (24 * 50_000, 24 * 3_000, "low")
    assert got["duration_seconds"] == 24 * 50_000 / 2_500_000


def test_batch(spark):
    got = estimate_batch(table(spark, "forex", "crypto"), DAY, DAY, category_stats(spark)).first()
    assert (got["total_hours"], got["compressed_bytes"], got["ticks"], got["confidence"]) == (48, 5_400_000, 360_000, "high")
    low = estimate_batch(table(spark, "forex", "other"), DAY, DAY, category_stats(spark)).first()
    assert low["confidence"] == "low" and low["compressed_bytes"] == 24 * 125_000


def test_empty_batch(spark):
    got = estimate_batch(table(spark, "forex").limit(0), DAY, DAY, category_stats(spark))
    assert rows(got) == [(0, 0, 0, 0, 0, 0.0, "high")]


def test_batch_range_must_run_forward(spark):
    with pytest.raises(ValueError):
        estimate_batch(table(spark, "forex"), DAY, DAY - dt.timedelta(days=1), category_stats(spark))


def test_peaks(spark):
    stats = spark.createDataFrame([("x", 100000, 5000, 2.0), ("y", 3, 1, 1.5)], CATEGORY_STATS)
    got = rows(peak_stats(stats).select("category", "peak_compressed_bytes_per_hour", "peak_ticks_per_hour"))
    assert got == [("x", 200000, 10000), ("y", 4, 1)]


def test_lookbacks(spark):
    got = estimate_lookbacks(table(spark, "forex", start="2023-01-01"), category_stats(spark), DAY)
    hours = {r["period"]: r["total_hours"] for r in got.collect()}
    assert hours == {
        "Last 1 day": 48,
        "Last 1 week": 8 * 24,
        "Last 1 month": 31 * 24,
        "Last 1 year": 366 * 24,
        "Full history": 366 * 24,
    }
    years = got.filter("period = 'Full history'").first()["years"]
    assert years == 365 / 365.25


def test_lookbacks_need_a_first_day(spark):
    stats = category_stats(spark)
    assert estimate_lookbacks(table(spark, "forex", start=None), stats, DAY).count() == 0
    # A first day still to come leaves the look-backs, but there is no history.
    assert estimate_lookbacks(table(spark, "forex", start="2030-01-01"), stats, DAY).count() == 4
