"""Size and time estimates of requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.category_stats import DEFAULT_STATS
from .requests import requests_totals

# Assumed line speed, uncompressed size over compressed size, look-back periods in days.
DEFAULT_MBPS = 10.0
COMPRESSION_RATIO = 10.0
LOOKBACKS = {"Last 1 day": 1, "Last 1 week": 7, "Last 1 month": 30, "Last 1 year": 365}
FULL_HISTORY = "Full history"


def with_category_stats(ranges: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the averages of each row's category, or the default ones where it has none."""
    found = stats.select("category", "avg_compressed_bytes_per_hour", "avg_ticks_per_hour", "peak_multiplier", F.lit(True).alias("known"))
    return (
        ranges.join(found, "category", "left")
        .withColumns(
            {
                name: F.coalesce(F.col(name), F.lit(value).cast("double" if name == "peak_multiplier" else "bigint"))
                for name, value in DEFAULT_STATS.items()
            }
        )
        .withColumn("known", F.coalesce("known", F.lit(False)))
    )


def _sizes(hours: Column, compressed: Column, ticks: Column, known: Column, mbps: float) -> list[Column]:
    inflated = (compressed.cast("double") * F.lit(COMPRESSION_RATIO)).cast("bigint")
    return [
        hours.alias("total_hours"),
        compressed.alias("compressed_bytes"),
        inflated.alias("uncompressed_bytes"),
        inflated.alias("output_bytes"),
        ticks.alias("ticks"),
        (compressed.cast("double") / F.lit(mbps * 1_000_000.0 / 8.0)).alias("duration_seconds"),
        F.when(known, F.lit("high")).otherwise(F.lit("low")).alias("confidence"),
    ]


def _estimate_rows(ranges: DataFrame, stats: DataFrame, mbps: float) -> DataFrame:
    """Estimate of each row of (instrument, category, start_date, end_date, ...)."""
    hours = F.col("hours_total")
    return with_category_stats(requests_totals(ranges), stats).select(
        *ranges.columns,
        *_sizes(
            hours,
            F.col("avg_compressed_bytes_per_hour") * hours,
            F.col("avg_ticks_per_hour") * hours,
            F.col("known"),
            mbps,
        ),
    )


def estimate(ranges: DataFrame, instruments: DataFrame, stats: DataFrame, mbps: float = DEFAULT_MBPS) -> DataFrame:
    """Estimate of each requested range (instrument, start_date, end_date); extra columns stay."""
    categories = instruments.select(F.col("id").alias("instrument"), "category")
    rows = ranges.drop("days_total", "hours_total").join(categories, "instrument", "left")
    return _estimate_rows(rows, stats, mbps)


def estimate_batch(
    instruments: DataFrame, start: dt.date, end: dt.date, stats: DataFrame, mbps: float = DEFAULT_MBPS
) -> DataFrame:
    """One estimate for all instruments over the same range, without clipping to their first days."""
    if start > end:
        raise ValueError(f"start date {start} is after end date {end}")
    hours = ((end - start).days + 1) * 24

    def total(name: str) -> Column:
        return (F.coalesce(F.sum(name), F.lit(0)) * F.lit(hours)).cast("bigint")

    summed = with_category_stats(instruments.select("category"), stats).agg(
        (F.count(F.lit(1)) * F.lit(hours)).alias("h"),
        total("avg_compressed_bytes_per_hour").alias("b"),
        total("avg_ticks_per_hour").alias("t"),
        F.coalesce(F.bool_and("known"), F.lit(True)).alias("k"),
    )
    return summed.select(*_sizes(F.col("h"), F.col("b"), F.col("t"), F.col("k"), mbps))


def peak_stats(stats: DataFrame) -> DataFrame:
    """Add peak bytes and ticks per hour to category statistics."""
    return stats.withColumns(
        {
            "peak_compressed_bytes_per_hour": (
                F.col("avg_compressed_bytes_per_hour").cast("double") * F.col("peak_multiplier")
            ).cast("bigint"),
            "peak_ticks_per_hour": (F.col("avg_ticks_per_hour").cast("double") * F.col("peak_multiplier")).cast(
                "bigint"
            ),
        }
    )


def estimate_lookbacks(
    instruments: DataFrame, stats: DataFrame, as_of: dt.date, mbps: float = DEFAULT_MBPS
) -> DataFrame:
    """Estimates of the usual look-backs and of the full history, for instruments with a known first day."""
    own = F.to_date("start_tick_date")
    periods = [
        F.struct(F.lit(name).alias("period"), F.lit(as_of - dt.timedelta(days=days)).alias("start_date"))
        for name, days in LOOKBACKS.items()
    ]
    periods.append(F.struct(F.lit(FULL_HISTORY).alias("period"), own.alias("start_date")))
    ranges = (
        instruments.filter(F.col("start_tick_date").isNotNull())
        .select(F.col("id").alias("instrument"), "category", F.inline(F.array(*periods)))
        .withColumn("end_date", F.lit(as_of))
        .filter(F.col("start_date") <= F.col("end_date"))
        .withColumn("years", F.date_diff("end_date", "start_date").cast("double") / F.lit(365.25))
    )
    return _estimate_rows(ranges, stats, mbps)
