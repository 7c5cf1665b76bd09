"""The archive as a data source."""

import datetime as dt

import pytest
from helpers import at, record, rows, write_hour
from pyspark.sql import functions as F

from quotemill import read_archive, read_archive_stream
from quotemill.schemas import FILE_STATUS, RAW_TICKS
from quotemill.sources import tick_source
from quotemill.sources.archive import DECODED


@pytest.fixture
def root(tmp_path):
    base = str(tmp_path / "archive")
    for name, day, hour, n in (("EURUSD", 15, 1, 2), ("EURUSD", 15, 23, 1), ("EURUSD", 16, 0, 3), ("BTCUSD", 15, 1, 5)):
        write_hour(base, f"{name}/2024/00/{day}/{hour:02d}h_ticks.bi5", record(0, 1, 1) * n)
    write_hour(base, "EURUSD/2023/11/31/23h_ticks.bi5", record(0, 1, 1))
    write_hour(base, "BTCUSD/2024/00/15/02h_ticks.bi5", b"x" * 25)
    write_hour(base, "EURUSD/2024/00/17/00h_ticks.bi5", b"", False)
    write_hour(base, "EURUSD/2024/12/17/00h_ticks.bi5", b"", False)  # no such month
    write_hour(base, "EURUSD/2024/00/15/24h_ticks.bi5", b"", False)  # no such hour
    return base


def hours(df):
    return rows(df.groupBy("instrument", F.date_format("hour", "dd HH").alias("h")).count())


def test_only_the_asked_files_can_fail_a_strict_read(spark, root):
    got = read_archive(spark, root, instruments=["EurUsd"], last_hour=at("2024-01-16 23:00:00"))
    assert got.schema == RAW_TICKS
    assert hours(got) == [("eurusd", "15 01", 2), ("eurusd", "15 23", 1), ("eurusd", "16 00", 3), ("eurusd", "31 23", 1)]
    got = read_archive(spark, root, first_hour=at("2024-01-15 23:00:00"), last_hour=dt.datetime(2024, 1, 16))
    assert hours(got) == [("eurusd", "15 23", 1), ("eurusd", "16 00", 3)]
    assert read_archive(spark, root, instruments=["nosuch"]).count() == 0
    with pytest.raises(Exception, match="invalid data length"):
        read_archive(spark, root, instruments=["btcusd"]).count()
    assert hours(read_archive(spark, root, "skip", instruments=["btcusd"])) == [("btcusd", "15 01", 5)]
    with pytest.raises(Exception, match="empty input"):
        read_archive(spark, root, instruments=["eurusd"], first_hour=at("2024-01-17 00:00:00")).count()


def test_filters_on_one_frame_do_not_disturb_each_other(spark, root):
    tick_source.register(spark)
    whole = spark.read.format("tick_archive").option("on_error", "skip").load(root)
    eur, btc = whole.filter("instrument = 'eurusd'"), whole.filter("instrument = 'btcusd'")
    assert (eur.count(), btc.count(), whole.count(), eur.union(btc).count()) == (7, 5, 12, 12)


def test_statuses_and_rows_of_both_kinds(spark, root):
    tick_source.register(spark)
    reader = spark.read.format("tick_archive").option("on_error", "skip")
    status = reader.option("rows", "status").load(root)
    assert status.schema == FILE_STATUS
    assert rows(status.groupBy("status").count()) == [("error", 2), ("ok", 5)]
    both = reader.option("rows", "both").load(root)
    assert both.schema == DECODED and both.count() == 12 + 7
    for option, value in (("rows", "some"), ("on_error", "ignore")):
        with pytest.raises(Exception, match=option):
            spark.read.format("tick_archive").option(option, value).load(root).count()


def test_planner_shares_days_out_by_bytes_and_lists_only_asked_folders(root, monkeypatch):
    listed = []
    plain = tick_source.Tree._entries
    monkeypatch.setattr(tick_source.Tree, "_entries", lambda self, folder: listed.append(folder) or plain(self, folder))
    monkeypatch.setattr(tick_source, "TASK_BYTES", 60)
    reader = tick_source.ArchiveReader(root, "fail", RAW_TICKS, {"eurusd"}, at("2024-01-15 00:00:00"), at("2024-01-16 05:00:00"))
    tasks = reader.partitions()
    assert [day for task in tasks for day in task.folders] == ["EURUSD/2024/00/15", "EURUSD/2024/00/16"]
    assert len(tasks) == 2
    assert not [folder for folder in listed if "BTC" in folder or "2023/" in folder or folder.endswith("17")]


@pytest.mark.parametrize(
    ("path", "hour"),
    [
        ("A/2024/00/15/07h_ticks.bi5", at("2024-01-15 07:00:00")),
        ("A/2024/11/31/23h_ticks.bi5", at("2024-12-31 23:00:00")),
        ("A/2024/12/01/00h_ticks.bi5", None),
        ("A/2023/01/29/00h_ticks.bi5", None),
        ("A/2024/00/15/24h_ticks.bi5", None),
        ("A/2024/00/15/07h_bars.bi5", None),
        ("A/2024/00/07h_ticks.bi5", None),
        ("A/x/00/15/07h_ticks.bi5", None),
    ],
)
def test_hours_of_paths(path, hour):
    assert tick_source.hour_of(path) == hour


def test_folders_cover_their_time():
    assert tick_source.day_of("A/2024") == (at("2024-01-01 00:00:00"), at("2024-12-31 23:00:00"))
    assert tick_source.day_of("A/2024/01") == (at("2024-02-01 00:00:00"), at("2024-02-29 23:00:00"))
    assert tick_source.day_of("A/2024/11") == (at("2024-12-01 00:00:00"), at("2024-12-31 23:00:00"))
    assert tick_source.day_of("A") is None and tick_source.day_of("A/9999/11/31") is None


def ingest(spark, root, tmp_path, **options):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    query = read_archive_stream(spark, root, "skip", **options).writeStream.format("parquet").option("checkpointLocation", log)
    query.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


def test_stream_goes_on_at_each_instruments_last_hour(spark, root, tmp_path):
    status = {"schema": FILE_STATUS}
    first = ingest(spark, root, tmp_path, **status)
    assert rows(first.groupBy("status").count()) == [("error", 2), ("ok", 5)]
    assert ingest(spark, root, tmp_path, **status).count() == 7
    write_hour(root, "BTCUSD/2024/00/15/03h_ticks.bi5", record(0, 1, 1))
    write_hour(root, "GBPUSD/2003/04/05/03h_ticks.bi5", record(0, 1, 1))  # an instrument that lands later, from its start
    write_hour(root, "EURUSD/2024/01/01/00h_ticks.bi5", b"", False)
    got = ingest(spark, root, tmp_path, **status)
    assert got.count() == 10 and got.dropDuplicates(["path"]).count() == 10
    assert rows(got.filter("n_ticks = 0 and status = 'error'").select(F.col("path")))[-1] == ("EURUSD/2024/01/01/00h_ticks.bi5",)


def test_lag_leaves_the_last_hours_for_later(spark, root, tmp_path):
    first = ingest(spark, root, tmp_path, lag_hours=1)
    assert hours(first.filter("instrument = 'btcusd'")) == [("btcusd", "15 01", 5)]
    write_hour(root, "BTCUSD/2024/00/15/03h_ticks.bi5", record(0, 1, 1))
    write_hour(root, "BTCUSD/2024/00/15/02h_ticks.bi5", record(0, 1, 1))
    assert hours(ingest(spark, root, tmp_path, lag_hours=1).filter("instrument = 'btcusd'")) == [("btcusd", "15 01", 5), ("btcusd", "15 02", 1)]
