"""Bars over a stream of ticks."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from ..functions.time import bar_start, timeframe_seconds
from ..operators.ohlcv import bar_aggregates, tick_order
from ..schemas import BARS


def ohlcv_stream(ticks: DataFrame, timeframe: str, lateness: str, wide_seq: bool = False) -> DataFrame:
    """Bars that close once the stream's time has passed their end by ``lateness``.

    In append mode each bar comes out once, closed; bars still open at the end of the input stay in the state
    (update and complete mode show them). ``lateness`` must cover the disorder of the input, since ticks later
    than that are dropped, which ``fail_on_late_rows`` finds; where no bound is known use ``write_partial_bars``,
    which keeps every tick.
    """
    seconds = timeframe_seconds(timeframe)
    late = ticks.withWatermark("timestamp", lateness)
    aggregates = bar_aggregates(tick_order(timeframe, wide_seq))
    if seconds is None:
        return late.groupBy("instrument", "timestamp").agg(*aggregates).select(*BARS.fieldNames())
    bars = late.groupBy("instrument", F.window("timestamp", f"{seconds} seconds").alias("bar")).agg(*aggregates)
    return bars.withColumn("timestamp", F.col("bar.start")).select(*BARS.fieldNames())


class LateRows(StreamingQueryListener):
    """Counts the rows that streams drop for lateness, over all their batches; one object for any number of streams."""

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self._ended: dict[str, Event] = {}

    def onQueryStarted(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event())

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        dropped = sum(operator.numRowsDroppedByWatermark for operator in event.progress.stateOperators)
        self.rows[run] = self.rows.get(run, 0) + dropped
        self.batches[run] = self.batches.get(run, 0) + 1

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended.setdefault(str(event.runId), Event()).set()

    def of(self, query: StreamingQuery, timeout: float = 60.0) -> int:
        """Rows that a query which has ended dropped; waits for its last report."""
        run = str(query.runId)
        if not self._ended.setdefault(run, Event()).wait(timeout):
            raise RuntimeError("the query has not ended, or began before its listener was added")
        return self.rows.get(run, 0)


def fail_on_late_rows(query: StreamingQuery, first_batch: int = 0, listener: LateRows | None = None) -> None:
    """Raise if any of the query's batches dropped rows for lateness, or if reports of batches are missing.

    A ``listener``, added to the session's streams before the query began, has seen all batches. Without one, Spark keeps
    the last ``spark.sql.streaming.numRecentProgressUpdates`` reports; for a run that continues an earlier one
    ``first_batch`` is then its first batch.
    """
    if listener is not None:
        late = listener.of(query)
    else:
        reports = query.recentProgress
        if reports and reports[0].batchId > first_batch:
            raise RuntimeError(f"no reports of the batches {first_batch} to {reports[0].batchId - 1} are left; use a listener")
        late = sum(op.numRowsDroppedByWatermark for batch in reports for op in batch.stateOperators)
    if late:
        raise RuntimeError(f"{late} rows came later than the allowed lateness and are not in the bars")


def partial_bars(ticks: DataFrame, timeframe: str, wide_seq: bool = False) -> DataFrame:
    """Bars of some of the ticks, with the order of their open and close, ready to be merged.

    Parts that are merged must agree in ``wide_seq``, which sets the type of those orders.
    """
    order = tick_order(timeframe, wide_seq)
    aggregates = [F.min(order).alias("open_order"), F.max(order).alias("close_order"), *bar_aggregates(order)]
    bars = ticks.groupBy("instrument", bar_start("timestamp", timeframe).alias("bar")).agg(*aggregates)
    return bars.withColumnRenamed("bar", "timestamp").select(*BARS.fieldNames(), "open_order", "close_order")


def merge_parts(parts: DataFrame) -> DataFrame:
    """Partial bars put together, still ready to be merged."""
    merged = parts.groupBy("instrument", "timestamp").agg(
        F.min_by("open", "open_order").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "close_order").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("tick_count").alias("tick_count"),
        F.min("open_order").alias("open_order"),
        F.max("close_order").alias("close_order"),
    )
    return merged.select(*BARS.fieldNames(), "open_order", "close_order")


def merge_partial_bars(parts: DataFrame) -> DataFrame:
    """Bars from partial bars, the same as ``ohlcv`` over all their ticks."""
    return merge_parts(parts).select(*BARS.fieldNames())


def write_partial_bars(ticks: DataFrame, timeframe: str, path: str, wide_seq: bool = False) -> DataStreamWriter:
    """Writer that adds each micro-batch's partial bars to the Parquet table at ``path``.

    No state and no watermark: ticks may come in any order and none is dropped. A repeated batch overwrites
    its own folder, which names the query too, so several streams can add to one table. ``merge_partial_bars`` over the table gives the bars so far, the open ones included.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the batch does not tell its query")
        partial_bars(batch, timeframe, wide_seq).write.mode("overwrite").parquet(f"{path}/query={query}/batch={batch_id}")

    return ticks.writeStream.foreachBatch(store)
