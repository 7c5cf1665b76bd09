"""Schemas of the engine's tables."""

from pyspark.sql import types as T

RAW_TICKS = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField("hour", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ms_offset", T.LongType()),
        T.StructField("ask_raw", T.LongType()),
        T.StructField("bid_raw", T.LongType()),
        T.StructField("ask_volume", T.FloatType()),
        T.StructField("bid_volume", T.FloatType()),
    ]
)

TICKS = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask_volume", T.FloatType()),
        T.StructField("bid_volume", T.FloatType()),
    ]
)

BARS = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("tick_count", T.LongType()),
    ]
)

INSTRUMENTS = T.StructType(
    [
        T.StructField("lookup_key", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("decimal_factor", T.LongType()),
        T.StructField("start_tick_date", T.TimestampType()),
    ]
)

CATEGORY_STATS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("avg_compressed_bytes_per_hour", T.LongType()),
        T.StructField("avg_ticks_per_hour", T.LongType()),
        T.StructField("peak_multiplier", T.DoubleType()),
    ]
)

# One row per opened archive file.
FILE_STATUS = T.StructType(
    [
        T.StructField("instrument", T.StringType()),
        T.StructField("hour", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("n_ticks", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
