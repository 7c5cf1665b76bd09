import datetime as dt
import glob
import os

import pytest
from helpers import record, rows, write_hour

from quotemill import download, download_all

DAY = dt.date(2024, 1, 15)


@pytest.fixture
def root(tmp_path):
    base = str(tmp_path / "archive")
    write_hour(base, "EURUSD/2024/00/15/03h_ticks.bi5", record(0, 110010, 110000) + record(1000, 110030, 110010))
    write_hour(base, "EURUSD/2024/00/15/01h_ticks.bi5", record(5, 110000, 109990))
    write_hour(base, "EURUSD/2024/00/15/05h_ticks.bi5", b"x" * 25)
    write_hour(base, "BTCUSD/2024/00/15/00h_ticks.bi5", record(0, 4_200_000, 4_199_900))
    return base


def lines(path):
    found = sorted(glob.glob(os.path.join(path, "**", "part-*"), recursive=True))
    return [line for p in found for line in open(p).read().splitlines() if not line.startswith("timestamp")]


def test_ticks_of_one_instrument(spark, root, tmp_path):
    out = str(tmp_path / "out")
    totals = download(spark, root, "EurUsd", out, start=DAY, end=DAY)
    assert rows(totals) == [("eurusd", 24, 2, 0, 21, 1, 3)]
    assert lines(out) == [
        "2024-01-15T01:00:00.005Z,1.1,1.0999,1,2",
        "2024-01-15T03:00:00.000Z,1.1001,1.1,1,2",
        "2024-01-15T03:00:01.000Z,1.1003,1.1001,1,2",
    ]


def test_bars_of_one_instrument(spark, root, tmp_path):
    out = str(tmp_path / "out")
    download(spark, root, "eurusd", out, start=DAY, as_of=DAY, timeframe="4h")
    (bar,) = lines(out)
    when, o, h, lo, c, volume, count = bar.split(",")
    assert (when, volume, count) == ("2024-01-15T00:00:00Z", "9", "3")
    assert [round(float(v), 6) for v in (o, h, lo, c)] == [1.09995, 1.1002, 1.09995, 1.1002]


def test_faults_can_stop_the_run(spark, root, tmp_path):
    with pytest.raises(Exception, match="invalid data length"):
        download(spark, root, "eurusd", str(tmp_path / "out"), start=DAY, end=DAY, on_error="fail")


def test_unknown_names(spark, root, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="unknown instrument"):
        download(spark, root, "nosuch", out, end=DAY)
    with pytest.raises(ValueError, match="no instruments"):
        download_all(spark, root, out, category="bond", end=DAY)
    with pytest.raises(ValueError, match="invalid timeframe"):
        download_all(spark, root, out, category="crypto", end=DAY, start=DAY, timeframe="w1")


def test_all_instruments_in_one_job(spark, root, tmp_path):
    out = str(tmp_path / "out")
    totals = download_all(spark, root, out, start=DAY, end=DAY, timeframe="d1", format="parquet")
    by_name = {r["instrument"]: (r["hours"], r["ticks"], r["skipped_hours"]) for r in totals.collect()}
    assert len(by_name) == 44
    assert by_name["eurusd"] == (24, 3, 1) and by_name["btcusd"] == (24, 1, 0)
    bars = spark.read.parquet(out)
    assert rows(bars.select("instrument", "tick_count")) == [("btcusd", 1), ("eurusd", 3)]


def test_run_goes_on_where_it_stopped(spark, root, tmp_path):
    table, runs = str(tmp_path / "table"), [str(tmp_path / f"out{i}") for i in range(3)]
    wide = {"start": DAY - dt.timedelta(days=1), "end": DAY, "timeframe": "d1"}
    first = download(spark, root, "eurusd", runs[0], table=table, **wide)
    assert rows(first) == [("eurusd", 48, 2, 0, 45, 1, 3)]
    write_hour(root, "EURUSD/2024/00/15/05h_ticks.bi5", record(0, 110010, 110000))
    again = download(spark, root, "eurusd", runs[1], table=table, start=DAY, end=DAY, timeframe="d1")
    clean = download(spark, root, "eurusd", runs[2], start=DAY, end=DAY, timeframe="d1")
    assert rows(again) == rows(clean) == [("eurusd", 24, 3, 0, 21, 0, 4)]
    assert lines(runs[1]) == lines(runs[2])
    opened = spark.read.parquet(table).filter("status is not null").groupBy("run").count().orderBy("run").collect()
    assert [r["count"] for r in opened] == [48, 22]


def test_output_is_checked_before_the_archive_is_read(spark, root, tmp_path):
    (tmp_path / "out").mkdir()
    table = tmp_path / "table"
    with pytest.raises(ValueError, match="output path exists"):
        download(spark, root, "eurusd", str(tmp_path / "out"), start=DAY, end=DAY, table=str(table))
    with pytest.raises(TypeError, match="unknown sink options: colour"):
        download(spark, root, "eurusd", str(tmp_path / "new"), start=DAY, end=DAY, table=str(table), colour=1)
    assert not table.exists()
