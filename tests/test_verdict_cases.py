"""Inputs that once gave wrong or lost rows in silence."""

import datetime as dt

import pytest
from helpers import record, ticks, write_hour

import quotemill as qm
from quotemill.operators.estimate import peak_stats, with_category_stats
from quotemill.operators.normalize import SEQ_PER_FILE
from quotemill.schemas import FILE_STATUS
from quotemill.sources.archive import decode_archive, list_archive
from quotemill.sources.category_stats import category_stats

HOUR = dt.datetime(2024, 1, 2, 3)


def raw(spark, rows):
    kinds = "instrument string, hour timestamp, seq bigint, ms_offset bigint, ask_raw bigint, bid_raw bigint, ask_volume float, bid_volume float"
    return spark.createDataFrame([("x", hour, seq, ms, 100, 100, 1.0, 1.0) for hour, seq, ms in rows], kinds)


def keys(spark, *rows):
    return spark.createDataFrame(rows, "lookup_key string, id string, decimal_factor bigint")


def test_tick_beyond_hour_and_file(spark):
    one = keys(spark, ("a", "x", 10))
    fits = qm.normalize_ticks(raw(spark, [(HOUR, SEQ_PER_FILE - 1, 3_600_000), (HOUR + dt.timedelta(hours=1), 0, 0)]), one)
    assert [r.seq < 0 for r in fits.orderBy("seq").collect()] == [True, False]
    inside = qm.normalize_ticks(raw(spark, [(HOUR, SEQ_PER_FILE + 5, 3_599_999)]), one)
    assert inside.first().seq == SEQ_PER_FILE + 5
    with pytest.raises(Exception, match="over its hour"):
        qm.normalize_ticks(raw(spark, [(HOUR, SEQ_PER_FILE + 5, 3_600_000)]), one).collect()


def test_two_keys_of_one_instrument(spark):
    ticks = raw(spark, [(HOUR, 0, 5)])
    assert qm.normalize_ticks(ticks, keys(spark, ("a", "x", 10), ("b", "x", 10))).count() == 1
    with pytest.raises(Exception, match="different decimal factors"):
        qm.normalize_ticks(ticks, keys(spark, ("a", "x", 10), ("b", "x", 100))).collect()
    day = dt.date(2024, 1, 2)
    ranges = spark.createDataFrame([("x", day, day)] * 2, "instrument string, start_date date, end_date date")
    assert qm.manifest(ranges).count() == 24


def test_two_streams_add_to_one_table(spark, tmp_path):
    kinds = "instrument string, timestamp timestamp, seq bigint, ask double, bid double, ask_volume float, bid_volume float"
    out = str(tmp_path / "bars")
    for name in ("a", "b"):
        rows = spark.createDataFrame([(name, HOUR, 0, 1.0, 1.0, 1.0, 1.0)], kinds)
        rows.write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
        writer = qm.write_partial_bars(stream, "h1", out).option("checkpointLocation", str(tmp_path / f"log-{name}"))
        writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.instrument for r in qm.merge_partial_bars(spark.read.parquet(out)).collect()) == ["a", "b"]


def test_late_rows_need_all_reports():
    class Report:
        batchId, stateOperators = 4, ()

    class Query:
        recentProgress = [Report()]

    with pytest.raises(RuntimeError, match="no reports"):
        qm.fail_on_late_rows(Query())
    qm.fail_on_late_rows(Query(), first_batch=4)


def test_unknown_category_has_default_peaks(spark):
    rows = spark.createDataFrame([("other",), ("forex",)], "category string")
    got = {r.category: r.peak_ticks_per_hour for r in peak_stats(with_category_stats(rows, category_stats(spark))).collect()}
    assert got == {"other": 6000, "forex": 12500}


def test_file_that_storage_refuses(spark, tmp_path):
    root = str(tmp_path / "root")
    write_hour(root, "EURUSD/2024/00/15/03h_ticks.bi5", record(0, 2, 1))
    (tmp_path / "root/EURUSD/2024/00/15/04h_ticks.bi5").mkdir()  # opens as no file does
    day = dt.date(2024, 1, 15)
    hours = qm.manifest(spark.createDataFrame([("eurusd", day, day)], "instrument string, start_date date, end_date date"))
    found = {r.hour.hour: (r.status, r.n_ticks) for r in qm.file_status(spark, root, hours).filter("status <> 'no_data'").collect()}
    assert found == {3: ("ok", 1), 4: ("error", 0)}
    assert qm.read_archive(spark, root, "skip", hours).count() == 1
    with pytest.raises(Exception, match="04h_ticks"):
        qm.read_archive(spark, root, "fail", hours).count()


def test_listed_file_that_is_gone(spark, tmp_path):
    rows = spark.createDataFrame([("eurusd", HOUR, "EURUSD/2024/00/02/03h_ticks.bi5")], "instrument string, hour timestamp, path string")
    assert decode_archive(rows, str(tmp_path), schema=FILE_STATUS).first().status == "no_data"
    assert decode_archive(rows, str(tmp_path), schema=FILE_STATUS, must_exist=True).first().status == "error"


def test_stream_of_listed_files_sees_empty_ones(spark, tmp_path):
    root, listing = str(tmp_path / "root"), str(tmp_path / "listing")
    write_hour(root, "EURUSD/2024/00/15/03h_ticks.bi5", record(0, 2, 1))
    (tmp_path / "root/EURUSD/2024/00/15/04h_ticks.bi5").write_bytes(b"")
    listed = list_archive(spark, root)
    listed.write.parquet(listing)

    def ingest(on_error):
        manifest = spark.readStream.schema(listed.schema).parquet(listing)
        status = qm.read_archive_stream(spark, root, on_error, schema=FILE_STATUS, manifest=manifest, partitions=2)
        query = status.writeStream.format("memory").queryName(f"status_{on_error}").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.hour.hour, r.status) for r in spark.table(f"status_{on_error}").collect())

    assert ingest("skip") == [(3, "ok"), (4, "error")]
    with pytest.raises(Exception, match="empty input"):
        ingest("fail")


def test_wide_sequence_numbers_in_partial_bars(spark):
    from quotemill.streaming.bars import partial_bars

    one = ticks(spark, ("2024-01-01 12:00:00", 1.0, 1.0), ("2024-01-01 12:10:00", 2.0, 2.0)).selectExpr(
        "* except (seq)", "seq + (1L << 60) as seq"
    )
    want = [(r.open, r.close) for r in qm.ohlcv(one, "d1", wide_seq=True).collect()]
    got = qm.merge_partial_bars(partial_bars(one, "d1", wide_seq=True)).collect()
    assert [(r.open, r.close) for r in got] == want == [(1.0, 2.0)]
