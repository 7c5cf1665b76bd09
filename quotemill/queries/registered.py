"""Queries over the given tables, one or more per operator."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from .. import operators as op
from ..plans import download_all
from ..schemas import BARS, FILE_STATUS, TICKS
from ..session import configure, shared_dir, task_width
from ..sinks import format_name, write_bars, write_tick_documents, write_ticks
from ..sources import category_stats, file_status, instruments, list_archive, read_archive
from ..sources.archive import explode_batches
from ..sources.run_table import land_run, landed_status, landed_ticks, publish_run
from ..streaming import (
    LateRows,
    closed_bars,
    fail_on_late_rows,
    merge_partial_bars,
    ohlcv_stream,
    read_archive_stream,
    read_partial_bars,
    use_keyed_state,
    write_compacted_bars,
    write_partial_bars,
)
from ..streaming.keyed import PROVIDER
from . import frames
from .fixture_archive import write_archive

Query = Callable[[SparkSession, str], DataFrame]

# Parameters that the queries and their SQL share.
MANIFEST_START, MANIFEST_END = dt.date(2001, 6, 1), dt.date(2001, 6, 2)
LATE_START, LATE_END = dt.date(1998, 3, 1), dt.date(2000, 12, 31)
IN_RANGE = (dt.date(2024, 1, 5), dt.date(2024, 1, 11))
BATCH_RANGE = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
SELECTED = ("click_0", "view_0")
SELECTED_HOURS = (dt.datetime(2024, 1, 6, 9), dt.datetime(2024, 1, 6, 13))
AS_OF = dt.date(2001, 8, 1)
LOOKUP_KEY = "Key17"
SEARCH_NAME, SEARCH_ID = "GEAR", "Rt19"
TIMEFRAME_ALIASES = ("1S", "minute", "5m", "MINUTE15", "30m", "Hour", "4H", "daily")
BAR_TIMEFRAMES = ("s1", "m1", "m5", "m15", "m30", "h1", "h4", "d1")

# What is wrong with the files of some hours of the day in the damaged archive.
FAULT_BY_HOUR = {3: "bad_length", 8: "zero_length", 14: "garbage", 20: "empty"}


def _ntz(df: DataFrame) -> DataFrame:
    """Timestamps without zone, floats as doubles, as the result check wants them."""
    kinds = {T.TimestampType(): "timestamp_ntz", T.FloatType(): "double"}
    return df.select(
        *[F.col(f.name).cast(kinds[f.dataType]) if f.dataType in kinds else F.col(f.name) for f in df.schema.fields]
    )


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return frames.raw_ticks(frames.events(spark, sf_dir))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.normalize_ticks(_raw(spark, sf_dir), frames.event_instruments(spark))


def _registry_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    raw = frames.raw_ticks(frames.events(spark, sf_dir), frames.registry_instrument())
    return op.normalize_ticks(raw, instruments(spark))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return frames.part_instruments(spark, sf_dir)


# --- archives written from the events, once per session and table folder

_ARCHIVES: dict[tuple, str] = {}


def _archive(spark: SparkSession, sf_dir: str, damaged: bool = False) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, damaged)
    if key not in _ARCHIVES:
        configure(spark)
        raw = frames.raw_ticks(frames.events(spark, sf_dir), frames.shard_instrument())
        fault = F.lit(None).cast("string")
        if damaged:
            for hour, name in FAULT_BY_HOUR.items():
                fault = F.when(F.hour("hour") == hour, name).otherwise(fault)
        root = shared_dir(spark, "archive")
        write_archive(raw, root, fault)
        _ARCHIVES[key] = root
    return _ARCHIVES[key]


def _shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each archived instrument the days from its first to its last event."""
    configure(spark)
    day = F.to_date("ts")
    return (
        frames.events(spark, sf_dir)
        .groupBy(frames.shard_instrument().alias("instrument"))
        .agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"))
    )


def _shard_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.manifest(_shard_ranges(spark, sf_dir))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = file_status(spark, _archive(spark, sf_dir, damaged=True))
    return op.coverage(_shard_manifest(spark, sf_dir), files)


def _archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(read_archive(spark, _archive(spark, sf_dir)))


def _selected_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict read of some instruments and hours of a damaged archive: the damaged files lie beyond them."""
    root = _archive(spark, sf_dir, damaged=True)
    return _ntz(read_archive(spark, root, instruments=SELECTED, first_hour=SELECTED_HOURS[0], last_hour=SELECTED_HOURS[1]))


def _strict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = read_archive(spark, _archive(spark, sf_dir), "fail", manifest=_shard_manifest(spark, sf_dir))
    return _ntz(
        raw.groupBy("instrument", "hour").agg(
            F.count(F.lit(1)).alias("n_ticks"), F.sum("ask_raw").alias("ask_sum"), F.max("seq").alias("last_seq")
        )
    )


def _resilient_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _archive(spark, sf_dir, damaged=True)
    return _ntz(read_archive(spark, root, "skip", manifest=_shard_manifest(spark, sf_dir)))


def _file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = file_status(spark, _archive(spark, sf_dir, damaged=True), _shard_manifest(spark, sf_dir))
    return _ntz(status.select("instrument", "hour", "path", "status", "n_ticks"))


def _unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses where storage refuses to open the files of an hour of the signups."""
    configure(spark)
    raw = frames.raw_ticks(frames.events(spark, sf_dir), frames.shard_instrument())
    root = shared_dir(spark, "archive")
    write_archive(raw, root, F.when(F.col("instrument").startswith("signup") & (F.hour("hour") == 8), "unreadable"))
    status = file_status(spark, root, _shard_manifest(spark, sf_dir))
    return _ntz(status.select("instrument", "hour", "path", "status", "n_ticks"))


def _list_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = list_archive(spark, _archive(spark, sf_dir, damaged=True))
    return _ntz(found.select("instrument", "hour", "path", (F.col("length") == 0).alias("zero_length")))


def _explode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as an hour batch of zero to three ticks; batches of error events are skipped hours."""
    raw = _raw(spark, sf_dir)
    size = F.when(F.col("instrument") == "error", 0).otherwise((F.col("ask_raw") - F.col("bid_raw")) % 4)
    ticks = [
        F.struct(
            F.lit(i).cast("bigint").alias("tick"),
            (F.col("ms_offset") + i).alias("ms_offset"),
            F.col("ask_raw").alias("ask_raw"),
        )
        for i in range(3)
    ]
    ticks = F.slice(F.array(*ticks), F.lit(1), size.cast("int"))
    batches = raw.select("instrument", "hour", "seq", ticks.alias("ticks"))
    return _ntz(explode_batches(batches))


def _registry_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per shipped instrument with its registry row."""
    configure(spark)
    used = frames.events(spark, sf_dir).groupBy(frames.registry_instrument().alias("id")).agg(
        F.count(F.lit(1)).alias("n_events")
    )
    return _ntz(used.join(instruments(spark), "id"))


def _category_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.with_category_stats(_parts(spark, sf_dir).select("id", "category"), category_stats(spark))
    return rows.select("id", "category", "avg_compressed_bytes_per_hour", "avg_ticks_per_hour", "known")


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(_ticks(spark, sf_dir))


def _normalize_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(_registry_ticks(spark, sf_dir))


def _overflow_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars where ticks of the same minute come from files up to two hours before it, far behind in them."""
    over = F.col("seq") % 3
    raw = _raw(spark, sf_dir).select(
        "instrument",
        (F.col("hour") - F.make_dt_interval(hours=over.cast("int"))).alias("hour"),
        (F.col("seq") + F.lit(1 << 25)).alias("seq"),
        (F.col("ms_offset") - F.col("ms_offset") % 60_000 + over * frames.HOUR_MS).alias("ms_offset"),
        "ask_raw",
        "bid_raw",
        "ask_volume",
        "bid_volume",
    )
    ticks = op.normalize_ticks(raw, frames.event_instruments(spark), wide_seq=True)
    return _ntz(op.ohlcv(ticks, "d1", wide_seq=True))


def _tick_column(name: str, column: Callable[[], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ticks(spark, sf_dir).select("seq", column().cast("double").alias(name))

    return query


def _bar_column(*names: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bars = fn.bar_metrics(op.ohlcv(_ticks(spark, sf_dir), "m30"))
        return _ntz(bars.select("instrument", "timestamp", *names))

    return query


def _archive_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("seq", fn.archive_path("instrument", "hour").alias("path"))


def _hour_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of all events, some of them spoilt, back to hours."""
    k = F.col("ask_raw") - F.col("bid_raw")
    path = fn.archive_path("instrument", "hour")
    spoilt = (
        F.when(k % 7 == 0, F.regexp_replace(path, "ticks", "bars"))
        .when(k % 7 == 1, F.regexp_replace(path, "/00/", "/12/"))
        .when(k % 7 == 2, F.substring_index(path, "/", -4))
        .when(k % 7 == 3, F.concat(F.lit("store://archive/"), path))
        .when(k % 7 == 4, F.regexp_replace(path, "[0-9]+h_", "24h_"))
        .otherwise(path)
    )
    return _ntz(_raw(spark, sf_dir).select("seq", fn.hour_from_path(spoilt).alias("hour")))


def _payload_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return documents.select("doc_id", fn.ticks_in_payload("n_chars").alias("n_ticks"))


def _get_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(op.get_instrument(_parts(spark, sf_dir), LOOKUP_KEY))


def _selected(select: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _ntz(select(_parts(spark, sf_dir)))


def _has_data_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines shipped at a time for which their part has data, per part."""
    configure(spark)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # Counting per part and day first leaves the join with far fewer rows than order lines.
    days = lines.groupBy("l_partkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))
    days = days.withColumn("instrument", frames.part_id("l_partkey"))
    parts = _parts(spark, sf_dir).select(F.col("id").alias("instrument"), "start_tick_date")
    joined = days.join(parts, "instrument")
    has = op.has_data_for(F.col("l_shipdate").cast("timestamp"))
    return joined.groupBy("instrument").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).cast("bigint").alias("with_data"),
        F.sum(F.when(has, 0).otherwise(F.col("n"))).cast("bigint").alias("without_data"),
    )


def _in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return frames.events(spark, sf_dir).filter(fn.in_range("ts", *IN_RANGE)).select("event_id", "ts")


def _timeframe_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = _ticks(spark, sf_dir)
    starts = [
        F.struct(
            F.lit(fn.parse_timeframe(alias)).alias("timeframe"),
            F.lit(fn.timeframe_seconds(alias)).cast("bigint").alias("seconds"),
            fn.bar_start("timestamp", alias).alias("bar"),
        )
        for alias in TIMEFRAME_ALIASES
    ]
    bars = ticks.select("instrument", F.inline(F.array(*starts))).groupBy("timeframe", "seconds", "instrument", "bar")
    per_bar = bars.agg(F.count(F.lit(1)).alias("n"))
    return per_bar.groupBy("timeframe", "seconds").agg(
        F.count(F.lit(1)).alias("bars"), F.sum("n").alias("ticks"), F.max("n").alias("most_ticks")
    )


def _bar_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = [fn.bar_start("timestamp", tf).alias(f"{tf}_start") for tf in ("tick", *BAR_TIMEFRAMES)]
    return _ntz(_ticks(spark, sf_dir).select("seq", *starts))


def _hour_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    spine = op.hour_spine(frames.order_ranges(spark, sf_dir))
    epoch_hour = F.call_function("div", F.unix_seconds("hour"), F.lit(3600))
    return _ntz(
        spine.groupBy("instrument").agg(
            F.count(F.lit(1)).alias("hours"),
            F.min("hour").alias("first_hour"),
            F.max("hour").alias("last_hour"),
            F.sum(epoch_hour).alias("hour_sum"),
        )
    )


def _range_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    rows = op.requests_totals(frames.lineitem_ranges(spark, sf_dir))
    return rows.groupBy("instrument").agg(F.sum("days_total").alias("days"), F.sum("hours_total").alias("hours"))


def _ohlcv(timeframe: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _ntz(op.ohlcv(_ticks(spark, sf_dir), timeframe))

    return query


def _registry_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(op.ohlcv(_registry_ticks(spark, sf_dir), "h1"))


def _wide_seq_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ticks whose sequence numbers do not fit beside the time in one bigint."""
    ticks = _ticks(spark, sf_dir).withColumn("seq", F.col("seq") + F.lit(1 << 60))
    return _ntz(op.ohlcv(ticks, "d1", wide_seq=True))


def _run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.run_totals(_coverage(spark, sf_dir))


def _stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed hourly bars of the event stream, an hour of lateness allowed."""
    configure(spark)
    raw = frames.raw_ticks(frames.events_stream(spark, sf_dir))
    bars = ohlcv_stream(op.normalize_ticks(raw, frames.event_instruments(spark)), "h1", "1 hour")
    return _ntz(_run_stream(spark, bars, "bars"))


def _stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(_run_stream(spark, read_archive_stream(spark, _archive(spark, sf_dir)), "ticks"))


def _stream_reader_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of all files of a damaged archive, zero-length ones included, without a listing."""
    stream = read_archive_stream(spark, _archive(spark, sf_dir, damaged=True), "skip", schema=FILE_STATUS)
    return _ntz(_run_stream(spark, stream, "status").select("instrument", "hour", "path", "status", "n_ticks"))


def _stream_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the listed files of a damaged archive, the listing being read as a stream."""
    root, listing = _archive(spark, sf_dir, damaged=True), shared_dir(spark, "listing")
    list_archive(spark, root).write.parquet(listing)
    listed = spark.readStream.schema(spark.read.parquet(listing).schema).parquet(listing)
    stream = read_archive_stream(spark, root, "skip", schema=FILE_STATUS, manifest=listed, partitions=task_width(spark))
    status = _run_stream(spark, stream, "status")
    return _ntz(status.select("instrument", "hour", "path", "status", "n_ticks"))


def _run_stream(spark: SparkSession, frame: DataFrame, purpose: str) -> DataFrame:
    out, log = shared_dir(spark, purpose), shared_dir(spark, "stream")
    writer = frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", log)
    listener = LateRows()
    spark.streams.addListener(listener)
    try:
        query = writer.trigger(availableNow=True).start(out)
        query.awaitTermination()
        fail_on_late_rows(query, listener=listener)
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(frame.schema).parquet(out)


def _stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event stream, the open ones included."""
    configure(spark)
    raw = frames.raw_ticks(frames.events_stream(spark, sf_dir))
    return _merged_stream(spark, op.normalize_ticks(raw, frames.event_instruments(spark)))


def _stateful_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars that closed when their instrument's next one began; late ticks are merged into theirs."""
    configure(spark)
    given = spark.conf.get(PROVIDER)
    raw = frames.raw_ticks(frames.events_stream(spark, sf_dir))
    use_keyed_state(spark)
    try:
        rows = _run_stream(spark, closed_bars(op.normalize_ticks(raw, frames.event_instruments(spark)), "h1"), "bars")
    finally:
        spark.conf.set(PROVIDER, given)
    return _ntz(merge_partial_bars(rows))


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars, the open ones included, of the events in eleven micro-batches whose parts are merged by threes."""
    configure(spark)
    source, out, log = (shared_dir(spark, name) for name in ("events", "bars", "stream"))
    events = frames.events(spark, sf_dir)
    events.repartition(11).write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ticks = op.normalize_ticks(frames.raw_ticks(stream), frames.event_instruments(spark))
    writer = write_compacted_bars(ticks, "h1", out, ratio=3).option("checkpointLocation", log)
    writer.trigger(availableNow=True).start().awaitTermination()
    return _ntz(merge_partial_bars(read_partial_bars(spark, out)))


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of all timeframes from one pass over the ticks."""
    tables = op.ohlcv_cascade(_ticks(spark, sf_dir), BAR_TIMEFRAMES)
    named = [bars.withColumn("timeframe", F.lit(name)) for name, bars in tables.items()]
    return _ntz(reduce(DataFrame.unionByName, named))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as one JSON array per instrument, read back from the instruments' files."""
    out = shared_dir(spark, "documents")
    write_tick_documents(_ticks(spark, sf_dir), out)
    kept = [f for f in _sink_schema(TICKS).fields if f.name != "instrument"]
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return _ntz(spark.read.schema(T.StructType(kept)).json(out, multiLine=True).withColumn("instrument", name))


def _file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each instrument's files first and last time, ticks, and how many begin before the one ahead of them ends."""
    out = shared_dir(spark, "ticks")
    write_ticks(_ticks(spark, sf_dir), out, "parquet")
    rows = spark.read.schema(_sink_schema(TICKS)).parquet(out)
    files = rows.groupBy("instrument", F.input_file_name().alias("file")).agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n")
    )
    early = F.expr("coalesce(first < lag(last) OVER (PARTITION BY instrument ORDER BY first, last), false)")
    return _ntz(
        files.withColumn("early", early)
        .groupBy("instrument")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("ticks"), F.count_if("early").alias("overlaps"))
    )


def _csv_lines(**options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The lines as they stand in the files, the headers of an instrument's files once."""
        out = shared_dir(spark, "ticks")
        write_ticks(_ticks(spark, sf_dir), out, "csv", **options)
        lines = spark.read.text(out).select("instrument", F.col("value").alias("line"))
        heads = F.col("line").startswith("timestamp")
        return lines.filter(~heads).unionByName(lines.filter(heads).distinct())

    return query


def _format_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the output format that a name stands for, in some spellings."""
    names = ("csv", "CSV", "json", "Json", "ndjson", "JSONL", "parquet", "pq", "PQ", "xml", "")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    found = frames.events(spark, sf_dir).select(format_name(name).alias("format"))
    return found.groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def _stream_archive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of a damaged archive read as a stream, its shards joined to their event types again."""
    raw = read_archive_stream(spark, _archive(spark, sf_dir, damaged=True), "skip")
    whole = raw.withColumn("instrument", F.substring_index("instrument", "_", 1))
    return _merged_stream(spark, op.normalize_ticks(whole, frames.event_instruments(spark)))


def _merged_stream(spark: SparkSession, ticks: DataFrame) -> DataFrame:
    out, log = shared_dir(spark, "bars"), shared_dir(spark, "stream")
    writer = write_partial_bars(ticks, "h1", out).option("checkpointLocation", log)
    writer.trigger(availableNow=True).start().awaitTermination()
    return _ntz(merge_partial_bars(spark.read.parquet(out)))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(op.manifest(op.requests(_parts(spark, sf_dir), MANIFEST_START, MANIFEST_END)))


def _requests(**kwargs) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op.requests(_parts(spark, sf_dir), **kwargs)

    return query


def _coverage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(_coverage(spark, sf_dir).select("instrument", "hour", "path", "status", "n_ticks"))


def _coverage_by_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.coverage_by_instrument(_coverage(spark, sf_dir))


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours still to fetch: all but the readable ones, Sundays being known to have no file."""
    manifest = _shard_manifest(spark, sf_dir)
    files = file_status(spark, _archive(spark, sf_dir, damaged=True))
    done = files.filter(F.col("status").isin("ok", "empty"))
    return _ntz(op.pending(manifest, done, manifest.filter(F.dayofweek("hour") == 1)))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    covered = _coverage(spark, sf_dir)
    return covered.groupBy("instrument").agg(
        F.count_if(F.col("status").isin("ok", "empty", "error")).alias("hours_completed"),
        F.count(F.lit(1)).alias("hours_total"),
    )


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.progress(_tasks(spark, sf_dir))


def _overall_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.overall_progress(_tasks(spark, sf_dir))


def _instrument_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.instrument_ids(_parts(spark, sf_dir))


def _instrument_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.instrument_count(_parts(spark, sf_dir))


def _estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return op.estimate(frames.lineitem_ranges(spark, sf_dir), parts, category_stats(spark))


def _estimate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.estimate_batch(_parts(spark, sf_dir), *BATCH_RANGE, category_stats(spark), mbps=25.0)


def _peak_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak volumes an hour of all parts of a category may bring."""
    parts = _parts(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return op.peak_stats(op.with_category_stats(parts, category_stats(spark))).select(
        "category",
        "n",
        (F.col("n") * F.col("peak_compressed_bytes_per_hour")).alias("peak_bytes"),
        (F.col("n") * F.col("peak_ticks_per_hour")).alias("peak_ticks"),
    )


def _lookbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.estimate_lookbacks(_parts(spark, sf_dir), category_stats(spark), AS_OF)


# --- sinks, written and read back


def _sink_schema(schema: T.StructType) -> T.StructType:
    kept = [f for f in schema.fields if f.name not in ("instrument", "seq")]
    return T.StructType([*kept, T.StructField("instrument", T.StringType())])


def _written_ticks(format: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = shared_dir(spark, "ticks")
        write_ticks(_ticks(spark, sf_dir), out, format, **options)
        return _ntz(_read_back(spark, out, TICKS, format, options))

    return query


def _written_bars(format: str, **options) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = shared_dir(spark, "bars")
        write_bars(op.ohlcv(_ticks(spark, sf_dir), "m15"), out, format, **options)
        return _ntz(_read_back(spark, out, BARS, format, options))

    return query


def _read_back(spark: SparkSession, path: str, schema: T.StructType, format: str, options: dict) -> DataFrame:
    reader = spark.read.schema(_sink_schema(schema))
    if format == "csv":
        return reader.csv(path, sep=options.get("delimiter", ","), header=options.get("header", True))
    if format == "json":
        return reader.json(path, multiLine=True)
    return reader.json(path) if format == "ndjson" else reader.parquet(path)


def _download_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run from a damaged archive to hourly bars in Parquet."""
    return _bars_of_runs(spark, sf_dir, _archive(spark, sf_dir, damaged=True))


def _resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars after a run over a damaged archive and one over the mended archive that opens only what was left.

    Hours whose file held no tick in the first run were read, so they stay as they were.
    """
    return _bars_of_runs(spark, sf_dir, _archive(spark, sf_dir, damaged=True), _archive(spark, sf_dir))


def _bars_of_runs(spark: SparkSession, sf_dir: str, *roots: str) -> DataFrame:
    """The bars that the last of some runs with one table of decoded hours writes."""
    ranges = _shard_ranges(spark, sf_dir)
    factors = frames.event_instruments(spark).withColumnRenamed("id", "event_type")
    shards = ranges.withColumn("event_type", F.substring_index("instrument", "_", 1)).join(factors, "event_type")
    listed = shards.select(
        F.col("instrument").alias("lookup_key"),
        F.col("instrument").alias("id"),
        F.col("instrument").alias("name"),
        F.col("event_type").alias("description"),
        F.lit("stock").alias("category"),
        "decimal_factor",
        F.col("start_date").cast("timestamp").alias("start_tick_date"),
    )
    end = frames.events(spark, sf_dir).agg(F.max(F.to_date("ts"))).first()[0]
    table = shared_dir(spark, "landed")
    wanted = {"category": "stock", "as_of": end, "timeframe": "h1", "format": "parquet", "instruments": listed}
    for root in roots:
        out = shared_dir(spark, "run")
        download_all(spark, root, out, table=table, **wanted)
    return _ntz(spark.read.schema(_sink_schema(BARS)).parquet(out))


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archived instruments with the factors of their event types."""
    factors = frames.event_instruments(spark).withColumnRenamed("id", "event_type")
    shards = _shard_ranges(spark, sf_dir).withColumn("event_type", F.substring_index("instrument", "_", 1))
    return shards.join(factors, "event_type").select(F.col("instrument").alias("id"), "decimal_factor")


def _concurrent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars after two runs that found the same hours pending, beside one that was never published.

    The first reads a damaged archive, so the second counts for the hours that were faulty there, and for those alone.
    """
    table, ranges = shared_dir(spark, "landed"), _shard_ranges(spark, sf_dir)
    todo = op.missing_hours(ranges, landed_status(spark, table).filter("status = 'ok'"))
    archives = [_archive(spark, sf_dir, damaged) for damaged in (True, False)]
    runs = [land_run(spark, root, table, todo)[0] for root in (*archives, archives[1])]
    for run in runs[:2]:
        publish_run(spark, table, run)
    ticks = op.normalize_ticks(landed_ticks(spark, table, ranges), _shards(spark, sf_dir))
    return _ntz(op.ohlcv(ticks, "h1"))


def _observed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours by status and ticks of a run, observed while its ticks were written."""
    table, ranges = shared_dir(spark, "landed"), _shard_ranges(spark, sf_dir)
    hours = op.expand(op.requested_ranges(ranges))
    _, totals = land_run(spark, _archive(spark, sf_dir, damaged=True), table, hours)
    names = ("hours", "ok_hours", "empty_hours", "no_data_hours", "skipped_hours", "ticks")
    return spark.createDataFrame([tuple(totals[name] for name in names)], ", ".join(f"{name} bigint" for name in names))


def _pending_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hours of ``C3_pending`` from the difference of ranges."""
    ranges = _shard_ranges(spark, sf_dir)
    done = file_status(spark, _archive(spark, sf_dir, damaged=True)).filter(F.col("status").isin("ok", "empty"))
    absent = op.expand(op.requested_ranges(ranges)).filter(F.dayofweek("hour") == 1)
    return _ntz(op.expand(op.pending_ranges(ranges, done, absent)))


def _hour_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with events of a user group as ranges without gaps."""
    configure(spark)
    group = F.concat(F.lit("g"), (F.col("user_id") % 50).cast("string"))
    hours = frames.events(spark, sf_dir).select(group.alias("instrument"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"))
    return _ntz(op.hour_ranges(hours))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-hour bars of all instruments."""
    return _ohlcv("h4")(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "S1_archive_scan": _archive_scan,
        "S1_list_archive": _list_archive,
        "S1_selected_scan": _selected_scan,
        "S2_strict_scan": _strict_scan,
        "S3_resilient_scan": _resilient_scan,
        "S3_file_status": _file_status,
        "S3_unreadable": _unreadable,
        "S4_explode_batches": _explode_batches,
        "S5_registry_join": _registry_join,
        "S6_category_stats": _category_stats,
        "P1_normalize": _normalize,
        "P1_normalize_registry": _normalize_registry,
        "P1_overflow_order": _overflow_order,
        "P2_mid": _tick_column("mid", fn.mid),
        "P3_spread": _tick_column("spread", fn.spread),
        "P4_total_volume": _tick_column("total_volume", fn.total_volume),
        "P5_range": _bar_column("range"),
        "P6_body": _bar_column("body"),
        "P7_is_bullish": _bar_column("is_bullish"),
        "P8_is_bearish": _bar_column("is_bearish"),
        "P9_typical_price": _bar_column("typical_price"),
        "P10_weighted_close": _bar_column("weighted_close"),
        "P11_archive_path": _archive_path,
        "P12_hour_from_path": _hour_from_path,
        "P13_ticks_in_payload": _payload_ticks,
        "F1_get_instrument": _get_instrument,
        "F2_by_category": _selected(lambda parts: op.by_category(parts, "ETF")),
        "F2_forex": _selected(op.forex),
        "F2_crypto": _selected(op.crypto),
        "F2_indices": _selected(op.indices),
        "F2_stocks": _selected(op.stocks),
        "F2_commodities": _selected(op.commodities),
        "F3_search_name": _selected(lambda parts: op.search(parts, SEARCH_NAME)),
        "F3_search_id": _selected(lambda parts: op.search(parts, SEARCH_ID)),
        "F4_list_category": _selected(lambda parts: op.list_instruments(parts, "bond", SEARCH_NAME)),
        "F4_list_pattern": _selected(lambda parts: op.list_instruments(parts, None, SEARCH_NAME)),
        "F4_list_all": _selected(op.list_instruments),
        "F5_has_data_for": _has_data_for,
        "F6_in_range": _in_range,
        "T1_timeframe_aliases": _timeframe_aliases,
        "T2_bar_start": _bar_start,
        "T3_hour_spine": _hour_spine,
        "T4_range_totals": _range_totals,
        **{f"A1_ohlcv_{tf}": _ohlcv(tf) for tf in BAR_TIMEFRAMES},
        "A1_ohlcv_wide_seq": _wide_seq_bars,
        "A1_cascade": _cascade,
        "A2_registry_bars_h1": _registry_bars,
        "A3_tick_bars": _ohlcv("tick"),
        "A4_run_totals": _run_totals,
        "A4_observed_totals": _observed_totals,
        "R1_stream_bars": _stream_bars,
        "R2_stream_archive": _stream_archive,
        "R2_stream_file_status": _stream_file_status,
        "R2_stream_reader_status": _stream_reader_status,
        "R2_stream_archive_bars": _stream_archive_bars,
        "R1_stateful_bars": _stateful_bars,
        "R3_stream_flush": _stream_flush,
        "R3_compacted": _compacted,
        "C1_manifest": _manifest,
        "C1_requests_default_start": _requests(as_of=LATE_END),
        "C1_requests_clipped": _requests(start=LATE_START, end=LATE_END),
        "C1b_requests_unclipped": _requests(start=LATE_START, end=LATE_END, clip=False),
        "C1b_requests_own_start": _requests(as_of=dt.date(2003, 12, 31), clip=False),
        "C2_coverage": _coverage_rows,
        "C2_coverage_by_instrument": _coverage_by_instrument,
        "C3_pending": _pending,
        "C3_pending_ranges": _pending_ranges,
        "C3_hour_ranges": _hour_ranges,
        "C3_resumed_run": _resumed_run,
        "C3_concurrent_runs": _concurrent_runs,
        "C4_progress": _progress,
        "C4_overall_progress": _overall_progress,
        "C5_instrument_ids": _instrument_ids,
        "C5_instrument_count": _instrument_count,
        "E1_estimate": _estimate,
        "E2_estimate_batch": _estimate_batch,
        "E3_peak_stats": _peak_stats,
        "E4_estimate_lookbacks": _lookbacks,
        "K1_csv_ticks": _written_ticks("csv"),
        "K2_csv_bars": _written_bars("csv"),
        "K3_tsv_no_header": _written_ticks("csv", delimiter="\t", header=False),
        "K4_ndjson_ticks": _written_ticks("ndjson"),
        "K4_ndjson_bars": _written_bars("ndjson"),
        "K5_json_ticks": _written_ticks("json"),
        "K5_json_bars_pretty": _written_bars("json", pretty=True),
        "K5_documents": _documents,
        "K6_parquet_ticks": _written_ticks("parquet", row_group_rows=1000, compression="zstd"),
        "K6_parquet_bars": _written_bars("parquet"),
        "K1_csv_lines": _csv_lines(),
        "K3_tsv_lines": _csv_lines(delimiter="\t", header=False),
        "K7_file_ranges": _file_ranges,
        "K8_format_names": _format_names,
        "K7_ordered_parquet_ticks": _written_ticks("parquet", ordered=True),
        "A2_download_all_h1": _download_all,
    }
