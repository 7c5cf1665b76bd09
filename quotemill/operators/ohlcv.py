"""Open/high/low/close/volume bars."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import mid, total_volume
from ..functions.time import bar_start, parse_timeframe, timeframe_seconds
from ..schemas import BARS
from ..session import shared_dir


def tick_order(timeframe: str, wide_seq: bool = False) -> Column:
    """Position of a tick inside its bar: time first, then file order.

    One bigint holds both, because an order made of a struct would turn the hash aggregation into a sort.
    The offset into the bar takes the high bits, which leaves a signed ``seq`` of 36 bits in a daily bar and
    more in shorter ones. ``wide_seq`` takes any ``seq`` by ordering on a decimal, still hashed but slower.
    """
    seq = F.col("seq")
    seconds = timeframe_seconds(timeframe)
    if seconds is None:
        return seq
    width = seconds * 1000
    offset = F.pmod(F.unix_millis("timestamp"), F.lit(width))
    if wide_seq:
        step = F.lit("1" + "0" * 20).cast("decimal(21,0)")
        return offset.cast("decimal(18,0)") * step + seq.cast("decimal(19,0)")
    step = 1 << (63 - (width - 1).bit_length())
    half = step >> 1
    beyond = F.raise_error(F.lit(f"seq must lie in [{-half}, {half}) for {timeframe} bars; use wide_seq=True"))
    fitting = F.when(seq.between(-half, half - 1), seq).otherwise(beyond.cast("bigint"))
    return offset * F.lit(step) + (fitting + F.lit(half))


def bar_aggregates(order: Column) -> list[Column]:
    """Aggregates of a bar over ticks; every one has a partial form, so only partial bars are shuffled."""
    price = mid()
    return [
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(total_volume().cast("double")).alias("volume"),
        F.count(F.lit(1)).alias("tick_count"),
    ]


def ohlcv(ticks: DataFrame, timeframe: str, wide_seq: bool = False) -> DataFrame:
    """One bar per instrument and non-empty bucket; the tick timeframe gives one bar per distinct time.

    Prices are mids; open and close follow (timestamp, seq), whatever the order or partitioning of the input.
    Times count in milliseconds, the precision of the archive.
    """
    bars = ticks.groupBy("instrument", bar_start("timestamp", timeframe).alias("bar")).agg(
        *bar_aggregates(tick_order(timeframe, wide_seq))
    )
    return bars.withColumnRenamed("bar", "timestamp").select(*BARS.fieldNames())


def coarser(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a wider timeframe from whole bars of a narrower one, whose width divides it: bars follow each other in time."""
    wide = bars.groupBy("instrument", bar_start("timestamp", timeframe).alias("bar")).agg(
        F.min_by("open", "timestamp").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("tick_count").alias("tick_count"),
    )
    return wide.withColumnRenamed("bar", "timestamp").select(*BARS.fieldNames())


def ohlcv_cascade(ticks: DataFrame, timeframes: Iterable[str], path: str | None = None, wide_seq: bool = False) -> dict[str, DataFrame]:
    """Bars of several timeframes from one pass over the ticks.

    Only the narrowest one reads ticks; its bars are written below ``path`` (or in the shared folder), and every wider one is
    made from the next narrower one, so a wide timeframe reads some thousand times fewer rows than there are ticks.
    """
    widths = {parse_timeframe(name): timeframe_seconds(name) for name in timeframes}
    if None in widths.values():
        raise ValueError("single ticks have no width; use ohlcv(ticks, 'tick')")
    made: dict[str, DataFrame] = {}
    for name in sorted(widths, key=widths.get):
        bars = coarser(next(reversed(made.values())), name) if made else ohlcv(ticks, name, wide_seq)
        where = f"{path}/{name}" if path else shared_dir(ticks.sparkSession, f"bars-{name}")
        bars.write.parquet(where)
        made[name] = ticks.sparkSession.read.schema(BARS).parquet(where)
    return made
