"""Runs that add to one table of decoded hours."""

import datetime as dt
import os

import pytest
from helpers import record, rows, write_hour
from pyspark.sql import functions as F

from quotemill import download, manifest
from quotemill.sources import archive as archive_module
from quotemill.sources.run_table import land_run, landed_status, landed_ticks, publish_run, published_runs

DAY = dt.date(2024, 1, 15)


@pytest.fixture
def root(tmp_path):
    base = str(tmp_path / "archive")
    write_hour(base, "EURUSD/2024/00/15/01h_ticks.bi5", record(5, 110000, 109990))
    write_hour(base, "EURUSD/2024/00/15/03h_ticks.bi5", record(0, 110010, 110000) + record(1000, 110030, 110010))
    write_hour(base, "EURUSD/2024/00/15/05h_ticks.bi5", b"x" * 25)
    write_hour(base, "EURUSD/2024/00/15/06h_ticks.bi5", b"")
    write_hour(base, "BTCUSD/2024/00/15/00h_ticks.bi5", record(0, 4_200_000, 4_199_900))
    return base


def day(spark, *names, start=DAY, end=DAY):
    return spark.createDataFrame([(name, start, end) for name in names], "instrument string, start_date date, end_date date")


def test_two_runs_that_found_the_same_hours_count_once(spark, root, tmp_path):
    table, hours = str(tmp_path / "table"), manifest(day(spark, "eurusd", "btcusd"))
    runs = [land_run(spark, root, table, hours)[0] for _ in range(3)]
    assert landed_ticks(spark, table).count() == 0 and published_runs(spark, table) == []
    publish_run(spark, table, runs[1])
    first = rows(landed_ticks(spark, table))
    assert len(first) == 4
    publish_run(spark, table, runs[0])
    assert published_runs(spark, table) == runs[:2]
    assert rows(landed_ticks(spark, table)) == first
    status = {r.status: r["count"] for r in landed_status(spark, table).groupBy("status").count().collect()}
    assert status == {"ok": 3, "empty": 1, "error": 1, "no_data": 43}


def test_the_first_run_that_finished_an_hour_counts(spark, root, tmp_path):
    """An hour read as empty stays so; a faulty one comes from the run that could read it."""
    table, hours = str(tmp_path / "table"), manifest(day(spark, "eurusd"))
    old, _ = land_run(spark, root, table, hours)
    for hour, n in ((1, 7), (5, 2), (6, 3)):
        write_hour(root, f"EURUSD/2024/00/15/0{hour}h_ticks.bi5", record(9, 1, 1) * n)
    new, totals = land_run(spark, root, table, hours)
    assert totals == {"hours": 24, "ok_hours": 4, "empty_hours": 0, "no_data_hours": 20, "skipped_hours": 0, "ticks": 14}
    publish_run(spark, table, new)
    publish_run(spark, table, old)
    got = landed_ticks(spark, table).groupBy(F.hour("hour").alias("h")).count()
    assert rows(got) == [(1, 1), (3, 2), (5, 2)]
    status = landed_status(spark, table).filter("status in ('ok', 'empty', 'error')")
    assert rows(status.select(F.hour("hour"), "status", "n_ticks")) == [(1, "ok", 1), (3, "ok", 2), (5, "ok", 2), (6, "empty", 0)]


def test_a_run_beside_an_older_one_does_not_double_bars(spark, root, tmp_path):
    """Two downloads on one table, the second having started before the first was published."""
    table = str(tmp_path / "table")
    run, _ = land_run(spark, root, table, manifest(day(spark, "eurusd")))
    download(spark, root, "eurusd", str(tmp_path / "a"), start=DAY, end=DAY, table=table, timeframe="d1", format="parquet")
    publish_run(spark, table, run)
    totals = download(spark, root, "eurusd", str(tmp_path / "b"), start=DAY, end=DAY, table=table, timeframe="d1", format="parquet")
    bars = [spark.read.parquet(str(tmp_path / out)).first() for out in "ab"]
    assert bars[0] == bars[1] and bars[0]["tick_count"] == 3
    assert rows(totals) == [("eurusd", 24, 2, 1, 20, 1, 3)]


def test_a_failed_run_leaves_nothing_to_see(spark, root, tmp_path):
    table = str(tmp_path / "table")
    with pytest.raises(Exception, match="invalid data length"):
        land_run(spark, root, table, manifest(day(spark, "eurusd")), on_error="fail")
    assert landed_status(spark, table).count() == 0


def test_other_instruments_and_months_are_not_scanned(spark, root, tmp_path):
    write_hour(root, "EURUSD/2024/01/03/01h_ticks.bi5", record(5, 1, 1))
    table = str(tmp_path / "table")
    run, _ = land_run(spark, root, table, manifest(day(spark, "eurusd", "btcusd", end=dt.date(2024, 2, 3))))
    publish_run(spark, table, run)
    assert sorted(os.listdir(f"{table}/run={run}/instrument=eurusd")) == ["month=2024-01", "month=2024-02"]
    ticks = landed_ticks(spark, table, day(spark, "eurusd"))
    assert ticks.count() == 3
    plan = ticks._jdf.queryExecution().toString()
    pruned = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "month" in pruned and "instrument" in pruned and "Join" not in plan
    assert landed_ticks(spark, table, day(spark)).count() == 0


def test_many_ranges_are_joined_and_few_are_a_condition(spark, root, tmp_path, monkeypatch):
    table = str(tmp_path / "table")
    run, _ = land_run(spark, root, table, manifest(day(spark, "eurusd", "btcusd")))
    publish_run(spark, table, run)
    asked = day(spark, "eurusd", "nosuch").union(day(spark, "btcusd", start=dt.date(2024, 1, 16), end=dt.date(2024, 1, 17)))
    few = rows(landed_ticks(spark, table, asked))
    monkeypatch.setattr("quotemill.sources.run_table.LISTED", 1)
    assert rows(landed_ticks(spark, table, asked)) == few and len(few) == 3


def test_tasks_get_hours_that_follow_each_other(spark):
    files = manifest(day(spark, "a", "b", end=dt.date(2024, 1, 20)))
    spread = archive_module.spread_files(files, 4, ordered=True).withColumn("task", F.spark_partition_id())
    tasks = spread.groupBy("task").agg(F.min(F.struct("instrument", "hour")).alias("low"), F.max(F.struct("instrument", "hour")).alias("high")).orderBy("low").collect()
    assert all(tuple(a.high) < tuple(b.low) for a, b in zip(tasks, tasks[1:]))
