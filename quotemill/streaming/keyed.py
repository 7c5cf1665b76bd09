"""Bars that close when the next bar's first tick arrives, one open bar per instrument."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ticks import mid, total_volume
from ..functions.time import bar_start
from ..operators.ohlcv import tick_order
from ..schemas import BARS

PARTIAL = T.StructType([f for f in BARS.fields if f.name != "instrument"] + [T.StructField(n, T.LongType()) for n in ("open_order", "close_order")])
CLOSED = T.StructType([BARS["instrument"], *PARTIAL.fields, T.StructField("late", T.BooleanType())])
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_FIELDS = PARTIAL.fieldNames()


def _parts(ticks: pd.DataFrame) -> pd.DataFrame:
    """Partial bars of some ticks of one instrument, by bar."""
    ticks = ticks.sort_values("order")
    bars = ticks.groupby("bar", sort=True)
    return pd.DataFrame(
        {
            "open": bars["price"].first(),
            "high": bars["price"].max(),
            "low": bars["price"].min(),
            "close": bars["price"].last(),
            "volume": bars["volume"].sum(),
            "tick_count": bars.size(),
            "open_order": bars["order"].first(),
            "close_order": bars["order"].last(),
        }
    ).rename_axis("timestamp").reset_index()[_FIELDS]


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Partial bars of the same buckets put together."""
    first = parts.sort_values("open_order").groupby("timestamp", sort=True)
    last = parts.sort_values("close_order").groupby("timestamp", sort=True)
    return pd.DataFrame(
        {
            "open": first["open"].first(),
            "high": first["high"].max(),
            "low": first["low"].min(),
            "close": last["close"].last(),
            "volume": first["volume"].sum(),
            "tick_count": first["tick_count"].sum(),
            "open_order": first["open_order"].min(),
            "close_order": first["close_order"].max(),
        }
    ).reset_index()[_FIELDS]


class OpenBar(StatefulProcessor):
    """Keeps the open bar of an instrument. A batch's ticks come in any order and in pieces, so they become bars first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", PARTIAL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.DataFrame(columns=_FIELDS)
        for ticks in rows:
            new = _parts(ticks)
            parts = new if parts.empty else _merged(pd.concat([parts, new], ignore_index=True))
        if parts.empty:
            return
        late = parts.iloc[:0]
        if self.open.exists():
            held = pd.DataFrame([self.open.get()], columns=_FIELDS)
            held["timestamp"] = pd.to_datetime(held["timestamp"]).astype(parts["timestamp"].dtype)
            before = parts["timestamp"] < held["timestamp"][0]
            late = parts[before]
            parts = _merged(pd.concat([held, parts[~before]], ignore_index=True))
        last = parts.iloc[-1]
        self.open.update(tuple(last[name].to_pydatetime() if name == "timestamp" else last[name].item() for name in _FIELDS))
        closed = parts.iloc[:-1]
        if len(late) or len(closed):
            out = pd.concat([frame.assign(late=is_late) for frame, is_late in ((late, True), (closed, False)) if len(frame)], ignore_index=True)
            out.insert(0, "instrument", key[0])
            yield out[CLOSED.fieldNames()]

    def close(self) -> None:
        pass


def closed_bars(ticks: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a stream of ticks, each when a tick of a later bar of its instrument has arrived.

    There is no watermark: an instrument's bars close by its own ticks, so a quiet one does not wait for a busy one, nor
    lose ticks to it. The open bar of each instrument is the only state. Ticks that belong before the open bar come out as
    rows with ``late``, as partial bars of their own; ``merge_partial_bars`` over all rows gives bars with them. Within a
    micro-batch ticks may come in any order.

    Rows have (instrument, timestamp, open, ..., tick_count, open_order, close_order, late). The session needs the RocksDB
    state store (``use_keyed_state``).
    """
    order = tick_order(timeframe)
    rows = ticks.select(
        "instrument",
        bar_start("timestamp", timeframe).alias("bar"),
        mid().alias("price"),
        total_volume().cast("double").alias("volume"),
        order.alias("order"),
    )
    return rows.groupBy("instrument").transformWithStateInPandas(OpenBar(), CLOSED, "Append", "None")


def use_keyed_state(spark) -> None:
    """Set the state store that keyed state needs, for streams that start from now on."""
    spark.conf.set(PROVIDER, ROCKSDB)
