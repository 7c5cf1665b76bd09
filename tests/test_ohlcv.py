import random

import pytest
from helpers import at, rows, ticks
from pyspark.sql import functions as F

from quotemill import normalize_ticks, ohlcv
from quotemill.schemas import RAW_TICKS, TICKS

INSTRUMENTS = "id string, decimal_factor bigint"


def test_minute_bars(spark):
    bars = ohlcv(
        ticks(
            spark,
            ("2024-01-01 12:00:00", 1.1001, 1.1000),
            ("2024-01-01 12:00:30", 1.1010, 1.1005),
            ("2024-01-01 12:01:00", 1.0990, 1.0985),
        ),
        "m1",
    )
    first, second = bars.orderBy("timestamp").collect()
    assert first["tick_count"] == 2 and first["volume"] == 400.0
    assert abs(first["open"] - 1.10005) < 1e-10 and abs(first["low"] - 1.10005) < 1e-10
    assert abs(first["close"] - 1.10075) < 1e-10 and abs(first["high"] - 1.10075) < 1e-10
    assert second["tick_count"] == 1  # the last, unfinished bar comes out too


def test_hour_bars_leave_gaps_empty(spark):
    bars = ohlcv(
        ticks(
            spark,
            ("2024-01-01 12:00:00", 1.1, 1.0),
            ("2024-01-01 12:30:00", 1.2, 1.1),
            ("2024-01-01 15:00:00", 1.3, 1.2),
        ),
        "1H",
    ).select(F.col("timestamp").cast("string"), "tick_count")
    assert rows(bars) == [("2024-01-01 12:00:00", 2), ("2024-01-01 15:00:00", 1)]


def test_same_millisecond_is_decided_by_file_order(spark):
    frame = ticks(
        spark,
        ("2024-01-01 12:00:00.001", 3.0, 3.0),
        ("2024-01-01 12:00:00.001", 1.0, 1.0),
        ("2024-01-01 12:00:00.001", 2.0, 2.0),
    )
    for timeframe in ("tick", "s1", "d1"):
        bar = ohlcv(frame.orderBy(F.desc("ask")), timeframe).first()
        assert (bar["open"], bar["high"], bar["low"], bar["close"], bar["tick_count"]) == (3.0, 3.0, 1.0, 2.0, 3)


def test_tick_bars(spark):
    frame = ticks(spark, ("2024-01-01 12:00:00.001", 1.0, 1.0), ("2024-01-01 12:00:00.002", 2.0, 2.0))
    assert ohlcv(frame, "tick").count() == 2


def test_large_seq(spark):
    base = ticks(spark, ("2024-01-01 23:59:59.998", 1.0, 1.0), ("2024-01-01 23:59:59.998", 2.0, 2.0))
    fits = base.withColumn("seq", F.lit((1 << 35) - 2) + F.col("seq"))
    assert ohlcv(fits, "d1").first()["close"] == 2.0
    wide = base.withColumn("seq", F.lit((1 << 62)) + F.col("seq"))
    with pytest.raises(Exception, match="wide_seq"):
        ohlcv(wide, "d1").collect()
    for shift in (0, -(1 << 63)):
        bar = ohlcv(wide.withColumn("seq", F.col("seq") + F.lit(shift)), "d1", wide_seq=True).first()
        assert (bar["open"], bar["close"]) == (1.0, 2.0)


def test_negative_seq(spark):
    frame = ticks(spark, ("2024-01-01 00:00:00", 1.0, 1.0), ("2024-01-01 00:00:00", 2.0, 2.0))
    for wide in (False, True):
        bar = ohlcv(frame.withColumn("seq", -F.col("seq")), "d1", wide).first()
        assert (bar["open"], bar["close"]) == (2.0, 1.0)


@pytest.mark.parametrize("timeframe", ["tick", "h1"])
def test_ticks_beyond_their_hour_come_before_the_next_file(spark, timeframe):
    first, second = at("2024-01-01 12:00:00"), at("2024-01-01 13:00:00")
    frame = raw(
        spark,
        ("a", second, 0, 0, 30, 30, 1.0, 1.0),
        ("a", second, 1, 0, 40, 40, 1.0, 1.0),
        ("a", first, 8, 3_600_000, 10, 10, 1.0, 1.0),
        ("a", first, 9, 3_600_000, 20, 20, 1.0, 1.0),
    )
    quotes = normalize_ticks(frame, spark.createDataFrame([("a", 10)], INSTRUMENTS))
    bar = ohlcv(quotes, timeframe).first()
    assert (bar["open"], bar["close"], bar["tick_count"]) == (1.0, 4.0, 4)


def brute_force(data, width_ms):
    """Bars of time-ordered ticks, one after the other."""
    bars = {}
    for name, when, seq, ask, bid, av, bv in sorted(data, key=lambda r: (r[0], r[1], r[2])):
        ms = int(when.timestamp() * 1000 + 0.5)
        price = (ask + bid) / 2
        bar = bars.setdefault((name, ms // width_ms), [price, price, price, price, 0.0, 0])
        bar[1], bar[2], bar[3] = max(bar[1], price), min(bar[2], price), price
        bar[4] += av + bv
        bar[5] += 1
    return bars


def random_ticks(n=3000, seed=7):
    rng = random.Random(seed)
    start = at("2024-01-01").timestamp()
    data = []
    for seq in range(n):
        name = "hot" if rng.random() < 0.5 else f"i{rng.randrange(20)}"
        when = at("2024-01-01").fromtimestamp(start + rng.randrange(2 * 86_400_000) / 1000, at("2024-01-01").tzinfo)
        data.append((name, when, seq, rng.randrange(1, 999) / 8, rng.randrange(1, 999) / 8, rng.randrange(9) / 4, 0.5))
    return data


@pytest.mark.parametrize("timeframe, seconds", [("s1", 1), ("m5", 300), ("h4", 14400), ("d1", 86400)])
def test_bars_against_brute_force_in_any_partitioning(spark, timeframe, seconds):
    data = random_ticks()
    want = brute_force(data, seconds * 1000)
    frame = spark.createDataFrame(data, TICKS)
    for shuffled in (frame, frame.repartition(7), frame.orderBy(F.desc("seq"))):
        bars = ohlcv(shuffled, timeframe).withColumn("ms", F.unix_millis("timestamp")).collect()
        got = {(r["instrument"], r["ms"] // (seconds * 1000)): list(r)[2:8] for r in bars}
        assert got == want


def test_aggregation_hashes_and_shuffles_partial_bars(spark):
    plan = ohlcv(ticks(spark, ("2024-01-01", 1.0, 1.0)), "d1")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2 and "partial_min_by" in plan


def raw(spark, *data):
    return spark.createDataFrame(data, RAW_TICKS)


def test_normalize(spark):
    frame = raw(
        spark,
        ("eurusd", at("2024-01-01 12:00:00"), 0, 1000, 110010, 110000, 100.0, 200.0),
        ("eurusd", at("2024-01-01 12:00:00"), 1, 3_600_001, 110010, 110000, 100.0, 200.0),
    )
    tick, beyond = normalize_ticks(frame, spark.createDataFrame([("eurusd", 100000)], INSTRUMENTS)).orderBy("timestamp").collect()
    assert tick["timestamp"] == at("2024-01-01 12:00:01").replace(tzinfo=None)
    assert (tick["ask"], tick["bid"], tick["ask_volume"], tick["bid_volume"]) == (1.1001, 1.1, 100.0, 200.0)
    assert beyond["timestamp"] == at("2024-01-01 13:00:00.001").replace(tzinfo=None)


def test_large_instrument_tables_are_shuffled_not_broadcast(spark):
    """The join has no broadcast hint: beyond the size limit it merges, with the same result for a hot key."""
    data = [
        ("hot" if i % 3 else f"i{i % 50}", at("2024-01-01"), i, i % 3_600_000, 1000 + i % 77, 900 + i % 13, 1.0, 0.5)
        for i in range(6000)
    ]
    frame = spark.createDataFrame(data, RAW_TICKS).repartition(6)
    table = spark.createDataFrame([("hot", 10)] + [(f"i{n}", n + 1) for n in range(2000)], INSTRUMENTS)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    want = rows(ohlcv(normalize_ticks(frame, table), "s1"))
    try:
        for key in keys:
            spark.conf.set(key, "-1")
        bars = ohlcv(normalize_ticks(frame, table), "s1")
        assert "SortMergeJoin" in bars._jdf.queryExecution().executedPlan().toString()
        assert rows(bars) == want
    finally:
        for key in keys:
            spark.conf.unset(key)
    assert sum(r[-1] for r in want) == 6000


def test_unknown_instrument_fails(spark):
    frame = raw(spark, ("nosuch", at("2024-01-01"), 0, 0, 1, 1, 1.0, 1.0))
    with pytest.raises(Exception, match="unknown instrument: nosuch"):
        normalize_ticks(frame, spark.createDataFrame([("eurusd", 100000)], INSTRUMENTS)).collect()
