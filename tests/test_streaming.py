import pytest
from helpers import at, record, rows, ticks, write_hour
from pyspark.sql import functions as F
from test_ohlcv import random_ticks

from quotemill import (
    fail_on_late_rows,
    merge_partial_bars,
    ohlcv,
    ohlcv_stream,
    read_archive,
    read_archive_stream,
    write_partial_bars,
)
from quotemill.schemas import TICKS


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream that reads each given frame as one micro-batch."""

    def make(*frames):
        source = str(tmp_path / "source")
        for frame in frames:
            frame.coalesce(1).write.mode("append").parquet(source)
        return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(source)

    return make


def run(spark, frame, mode, name):
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_append_mode_gives_closed_bars(spark, stream_of):
    stream = stream_of(
        ticks(spark, ("2024-01-01 12:00:00", 1.0, 1.0), ("2024-01-01 12:10:00", 2.0, 2.0)),
        ticks(spark, ("2024-01-01 12:50:00", 3.0, 3.0), ("2024-01-01 13:30:00", 4.0, 4.0)),
    )
    bars = run(spark, ohlcv_stream(stream, "h1", "10 minutes"), "append", "closed")
    got = rows(bars.select(F.col("timestamp").cast("string"), "open", "close", "tick_count"))
    assert got == [("2024-01-01 12:00:00", 1.0, 3.0, 3)]


@pytest.mark.parametrize("timeframe", ["tick", "m15", "d1"])
def test_complete_mode_equals_batch(spark, stream_of, timeframe):
    data = random_ticks(800)
    frames = [spark.createDataFrame(data[i::3], TICKS) for i in range(3)]
    stream = stream_of(*frames)
    bars = run(spark, ohlcv_stream(stream, timeframe, "3 days"), "complete", f"all_{timeframe}")
    assert rows(bars) == rows(ohlcv(spark.createDataFrame(data, TICKS), timeframe))


def test_partial_bars_keep_ticks_of_any_age(spark, stream_of, tmp_path):
    data = random_ticks(800)
    newest_first = sorted(data, key=lambda r: r[1], reverse=True)
    stream = stream_of(*[spark.createDataFrame(newest_first[i : i + 200], TICKS) for i in range(0, 800, 200)])
    out = str(tmp_path / "parts")
    writer = write_partial_bars(stream, "h4", out).option("checkpointLocation", str(tmp_path / "log"))
    writer.trigger(availableNow=True).start().awaitTermination()
    parts = spark.read.parquet(out)
    assert parts.select("batch").distinct().count() == 4
    assert rows(merge_partial_bars(parts)) == rows(ohlcv(spark.createDataFrame(data, TICKS), "h4"))


def test_late_ticks_are_reported(spark, stream_of, tmp_path):
    stream = stream_of(
        ticks(spark, ("2024-01-01 12:00:00", 1.0, 1.0)),
        ticks(spark, ("2024-01-03 12:00:00", 1.0, 1.0)),
        ticks(spark, ("2024-01-03 13:00:00", 1.0, 1.0)),
        ticks(spark, ("2024-01-01 12:00:01", 1.0, 1.0)),
    )
    bars = ohlcv_stream(stream, "h1", "10 minutes")
    query = bars.writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    query.awaitTermination()
    with pytest.raises(RuntimeError, match="1 rows came later"):
        fail_on_late_rows(query)


def test_flush_of_one_tick(spark):
    bar = ohlcv(ticks(spark, ("2024-01-01 12:00:00", 1.1, 1.0)), "h1").first()
    assert bar["tick_count"] == 1


def test_archive_stream(spark, tmp_path):
    root, out, log = (str(tmp_path / n) for n in ("root", "out", "log"))

    def ingest():
        query = read_archive_stream(spark, root, max_files_per_trigger=1).writeStream.format("parquet")
        query.option("checkpointLocation", log).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.parquet(out)

    write_hour(root, "EURUSD/2024/00/15/12h_ticks.bi5", record(0, 1, 1) + record(1, 2, 2))
    write_hour(root, "EURUSD/2024/00/15/13h_ticks.bi5", record(0, 3, 3))
    write_hour(root, "EURUSD/2024/12/15/13h_ticks.bi5", record(0, 3, 3))  # no such month
    assert ingest().count() == 3
    write_hour(root, "GBPUSD/2024/00/15/12h_ticks.bi5", record(7, 4, 4))
    landed = ingest()
    assert landed.count() == 4
    known = landed.filter(F.col("instrument") == "gbpusd").select("hour", "ms_offset").first()
    assert known == (at("2024-01-15 12:00:00").replace(tzinfo=None), 7)
    assert rows(landed) == rows(read_archive(spark, root))
