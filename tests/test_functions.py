import datetime as dt
import math

import pytest
from helpers import at, ticks
from pyspark.sql import functions as F

from quotemill import (
    archive_path,
    bar_metrics,
    bar_start,
    hour_from_path,
    in_range,
    mid,
    parse_timeframe,
    spread,
    ticks_in_payload,
    timeframe_seconds,
    total_volume,
)
from quotemill.functions import TIMEFRAMES
from quotemill.schemas import BARS


def test_tick_columns(spark):
    row = ticks(spark, ("2024-01-01 12:00:00", 1.1001, 1.1000)).select(
        mid().alias("mid"), spread().alias("spread"), total_volume().alias("volume")
    )
    assert row.schema["volume"].dataType.simpleString() == "float"
    m, s, v = row.first()
    assert abs(m - 1.10005) < 1e-10 and abs(s - 0.0001) < 1e-10 and v == 200.0


def test_volumes_add_in_32_bits(spark):
    row = spark.range(1).select(
        F.lit(16777216.0).cast("float").alias("ask_volume"), F.lit(1.0).cast("float").alias("bid_volume")
    )
    # 2**24 + 1 has no 32-bit float; added as doubles it would be 16777217.
    assert row.select(total_volume().cast("double")).first()[0] == 16777216.0


def bar(spark, o, h, lo, c):
    frame = spark.createDataFrame([("eurusd", at("2024-01-01"), o, h, lo, c, 1.0, 1)], BARS)
    return bar_metrics(frame).first()


def test_bar_metrics(spark):
    b = bar(spark, 1.1000, 1.1050, 1.0980, 1.1020)
    assert abs(b["range"] - 0.0070) < 1e-10 and abs(b["body"] - 0.0020) < 1e-10
    assert b["is_bullish"] and not b["is_bearish"]
    assert b["typical_price"] == (1.1050 + 1.0980 + 1.1020) / 3.0
    assert b["weighted_close"] == (1.1050 + 1.0980 + 2.0 * 1.1020) / 4.0


def test_falling_and_flat_bars(spark):
    falling = bar(spark, 1.1020, 1.1050, 1.0980, 1.1000)
    assert falling["is_bearish"] and not falling["is_bullish"]
    flat = bar(spark, 1.1, 1.2, 1.0, 1.1)
    assert not flat["is_bearish"] and not flat["is_bullish"]


def test_timeframe_names():
    assert [parse_timeframe(n) for n in ("m1", "1h", "H4", "Daily", "second")] == ["m1", "h1", "h4", "d1", "s1"]
    assert [timeframe_seconds(n) for n in ("tick", "m1", "h1", "d1")] == [None, 60, 3600, 86400]
    with pytest.raises(ValueError, match="invalid timeframe"):
        parse_timeframe("invalid")
    assert len(TIMEFRAMES) == 9


@pytest.mark.parametrize(
    "timeframe, start",
    [
        ("tick", "14:37:45.123"),
        ("s1", "14:37:45"),
        ("m1", "14:37:00"),
        ("m5", "14:35:00"),
        ("m15", "14:30:00"),
        ("m30", "14:30:00"),
        ("h1", "14:00:00"),
        ("h4", "12:00:00"),
        ("d1", "00:00:00"),
    ],
)
@pytest.mark.parametrize("day", ["2024-01-15", "1969-12-30"])
def test_bar_start(spark, timeframe, start, day):
    frame = ticks(spark, (f"{day} 14:37:45.123", 1.0, 1.0))
    text = frame.select(bar_start("timestamp", timeframe).cast("string")).first()[0]
    assert text == f"{day} {start}"


def test_archive_path(spark):
    frame = spark.createDataFrame(
        [("eurusd", at("2024-01-15 12:00:00")), ("btcusd", at("2024-12-31 23:00:00")), ("GBPJPY", at("2024-06-01"))],
        "i string, h timestamp",
    )
    assert [r[0] for r in frame.select(archive_path("i", "h")).collect()] == [
        "EURUSD/2024/00/15/12h_ticks.bi5",
        "BTCUSD/2024/11/31/23h_ticks.bi5",
        "GBPJPY/2024/05/01/00h_ticks.bi5",
    ]


@pytest.mark.parametrize(
    "path, hour",
    [
        ("https://example.org/feed/EURUSD/2024/00/15/12h_ticks.bi5", "2024-01-15 12:00:00"),
        ("EURUSD/2024/11/31/23h_ticks.bi5", "2024-12-31 23:00:00"),
        ("/2024/00/15/12h_ticks.bi5", "2024-01-15 12:00:00"),
        ("2024/00/15/12h_ticks.bi5", None),  # four parts only
        ("EURUSD/2024/00/15/12h_bars.bi5", None),
        ("EURUSD/2024/00/15/h_ticks.bi5", None),
        ("EURUSD/2024/00/15/24h_ticks.bi5", None),
        ("EURUSD/2024/12/15/12h_ticks.bi5", None),
        ("EURUSD/2024/01/30/12h_ticks.bi5", None),  # 30 February
        ("EURUSD/2024/-1/15/12h_ticks.bi5", None),
        ("EURUSD/x/00/15/12h_ticks.bi5", None),
        ("EURUSD/2024/00/99999999999/12h_ticks.bi5", None),
        ("", None),
    ],
)
def test_hour_from_path(spark, path, hour):
    frame = spark.createDataFrame([(path,)], "p string").select(hour_from_path("p").cast("string"))
    assert frame.first()[0] == hour


def test_paths_of_all_hours_lead_back(spark):
    hours = spark.range(0, 30 * 366 * 24, 7).select(F.timestamp_seconds(F.col("id") * 3600 + 978307200).alias("hour"))
    paths = hours.withColumn("path", archive_path(F.lit("abc"), "hour"))
    assert paths.filter(~hour_from_path("path").eqNullSafe(F.col("hour"))).count() == 0


def test_ticks_in_payload(spark):
    frame = spark.createDataFrame([(0,), (20,), (200,), (219,)], "n bigint")
    assert [r[0] for r in frame.select(ticks_in_payload("n")).collect()] == [0, 1, 10, 10]


def test_in_range(spark):
    frame = spark.createDataFrame(
        [(at(t),) for t in ("2024-01-01 23:59:59.999", "2024-01-02", "2024-01-03 23:59:59.999", "2024-01-04")],
        "t timestamp",
    )
    kept = frame.filter(in_range("t", dt.date(2024, 1, 2), dt.date(2024, 1, 3)))
    assert kept.count() == 2
    with pytest.raises(ValueError):
        in_range("t", dt.date(2024, 1, 3), dt.date(2024, 1, 2))


def test_in_range_reaches_the_scan(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = frame.filter(in_range("ts", dt.date(2024, 1, 2), dt.date(2024, 1, 3)))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-02T00:00), LessThan(ts,2024-01-04" in plan


def test_metrics_of_zero_price_are_finite(spark):
    assert not math.isnan(bar(spark, 0.0, 0.0, 0.0, 0.0)["typical_price"])
