"""Bars by keyed state, compacted partial bars, late rows by a listener, and the cascade of timeframes."""

import os

import pytest
from helpers import rows, ticks
from pyspark.sql import functions as F
from test_ohlcv import random_ticks
from test_streaming import stream_of  # noqa: F401

from quotemill import (
    LateRows,
    closed_bars,
    fail_on_late_rows,
    merge_partial_bars,
    ohlcv,
    ohlcv_cascade,
    ohlcv_stream,
    read_partial_bars,
    use_keyed_state,
    vacuum_partial_bars,
    write_compacted_bars,
)
from quotemill.schemas import BARS, TICKS
from quotemill.streaming.compaction import LiveParts
from quotemill.streaming.keyed import PROVIDER


@pytest.fixture
def keyed(spark):
    given = spark.conf.get(PROVIDER)
    use_keyed_state(spark)
    yield
    spark.conf.set(PROVIDER, given)


def run(spark, frame, tmp_path, name="keyed"):
    out = str(tmp_path / name)
    writer = frame.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-log"))
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def shown(bars):
    return rows(bars.select("instrument", F.date_format("timestamp", "dd HH"), "open", "close", "tick_count", "late"))


def test_a_bar_closes_by_its_own_instruments_next_tick(spark, stream_of, tmp_path, keyed):  # noqa: F811
    stream = stream_of(
        ticks(spark, ("busy", "2024-01-01 12:40:00", 2.0, 2.0), ("busy", "2024-01-01 12:10:00", 1.0, 1.0), ("quiet", "2024-01-01 12:00:00", 9.0, 9.0)),
        ticks(spark, ("busy", "2024-01-01 12:50:00", 3.0, 3.0), ("busy", "2024-01-01 15:00:00", 4.0, 4.0)),
        ticks(spark, ("busy", "2024-01-03 15:00:00", 5.0, 5.0)),
        ticks(spark, ("quiet", "2024-01-01 12:30:00", 8.0, 8.0), ("busy", "2024-01-01 12:55:00", 7.0, 7.0)),
        ticks(spark, ("quiet", "2024-01-01 13:00:00", 8.0, 8.0)),
    )
    got = run(spark, closed_bars(stream, "h1"), tmp_path)
    assert shown(got) == [
        ("busy", "01 12", 1.0, 3.0, 3, False),
        ("busy", "01 12", 7.0, 7.0, 1, True),
        ("busy", "01 15", 4.0, 4.0, 1, False),
        ("quiet", "01 12", 9.0, 8.0, 2, False),
    ]
    merged = {r.timestamp.hour: (r.open, r.close, r.tick_count) for r in merge_partial_bars(got.filter("instrument = 'busy'")).collect()}
    assert merged == {12: (1.0, 7.0, 4), 15: (4.0, 4.0, 1)}


@pytest.mark.parametrize("timeframe", ["tick", "s1", "h4"])
def test_keyed_bars_and_late_parts_make_all_closed_bars(spark, stream_of, tmp_path, keyed, timeframe):  # noqa: F811
    data = random_ticks(900)
    got = run(spark, closed_bars(stream_of(*[spark.createDataFrame(data[i::4], TICKS) for i in range(4)]), timeframe), tmp_path)
    bars = ohlcv(spark.createDataFrame(data, TICKS), timeframe)
    last = bars.groupBy("instrument").agg(F.max("timestamp").alias("last"))
    want = bars.join(last, "instrument").filter("timestamp < last").select(*bars.columns)
    assert rows(merge_partial_bars(got)) == rows(want)


def compacted(spark, stream, tmp_path, **options):
    out = str(tmp_path / "bars")
    writer = write_compacted_bars(stream, "h4", out, **options).option("checkpointLocation", str(tmp_path / "log"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return out, query.id


def test_parts_are_merged_in_tiers(spark, stream_of, tmp_path):  # noqa: F811
    data = random_ticks(900)
    frames = [spark.createDataFrame(data[i::9], TICKS) for i in range(9)]
    out, query = compacted(spark, stream_of(*frames[:8]), tmp_path, ratio=2)
    live = LiveParts(spark, out, query)
    assert [(p["level"], p["first"], p["last"]) for p in live.read()] == [(3, 0, 7)]
    assert live.versions() == list(range(8))
    assert [(p["level"], p["first"], p["last"]) for p in live.read(6)] == [(2, 0, 3), (1, 4, 5), (0, 6, 6)]
    whole = rows(ohlcv(spark.createDataFrame([row for i in range(8) for row in data[i::9]], TICKS), "h4"))
    assert rows(merge_partial_bars(read_partial_bars(spark, out))) == whole
    # A batch that is run again after its list was published adds nothing; one that failed before is written over.
    live.add(read_partial_bars(spark, out), 7, 2)
    assert rows(merge_partial_bars(read_partial_bars(spark, out))) == whole
    os.makedirs(live.where({"level": 0, "first": 8, "last": 8}))
    compacted(spark, stream_of(frames[8]), tmp_path, ratio=2)
    assert [(p["level"], p["first"], p["last"]) for p in live.read()] == [(3, 0, 7), (0, 8, 8)]
    want = rows(ohlcv(spark.createDataFrame(data, TICKS), "h4"))
    assert rows(merge_partial_bars(read_partial_bars(spark, out))) == want
    assert vacuum_partial_bars(spark, out) > 0 and vacuum_partial_bars(spark, out) == 0
    assert len(os.listdir(f"{out}/query={query}")) == 2 and live.versions() == [8]
    assert rows(merge_partial_bars(read_partial_bars(spark, out))) == want


def test_no_parts_yet_and_no_such_ratio(spark, stream_of, tmp_path):  # noqa: F811
    assert read_partial_bars(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError, match="two parts"):
        write_compacted_bars(stream_of(ticks(spark, ("2024-01-01 12:00:00", 1.0, 1.0))), "h1", "x", ratio=1)


def test_a_listener_sees_all_batches(spark, stream_of, tmp_path):  # noqa: F811
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        days = [ticks(spark, (f"2024-01-{day:02d} 12:00:00", 1.0, 1.0)) for day in (1, 9, 10, 2, 3, 11)]
        query = ohlcv_stream(stream_of(*days), "h1", "10 minutes").writeStream.format("memory").queryName("all_late")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        assert listener.of(query) == 2
        with pytest.raises(RuntimeError, match="2 rows came later"):
            fail_on_late_rows(query, listener=listener)
        with pytest.raises(RuntimeError, match="no reports of the batches"):
            fail_on_late_rows(query)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")


def test_cascade_equals_bars_of_each_timeframe(spark, tmp_path):
    frame = spark.createDataFrame(random_ticks(1500), TICKS)
    made = ohlcv_cascade(frame, ["1h", "s1", "m5", "daily"], str(tmp_path / "bars"))
    assert list(made) == ["s1", "m5", "h1", "d1"] and all(bars.schema == BARS for bars in made.values())
    for name, bars in made.items():
        assert rows(bars) == rows(ohlcv(frame, name))
    assert sorted(os.listdir(tmp_path / "bars")) == ["d1", "h1", "m5", "s1"]
    with pytest.raises(ValueError, match="single ticks"):
        ohlcv_cascade(frame, ["tick", "h1"])
