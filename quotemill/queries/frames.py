"""The given tables as the engine's inputs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INSTRUMENTS, RAW_TICKS
from ..sources.registry import REGISTRY, check_factors, lines_table

HOUR_MS = 3_600_000
SHARD_EVENTS = 65_536

# Decimal factors of the event types when each counts as an instrument.
EVENT_FACTORS = {"click": 100000, "view": 1000, "purchase": 100, "error": 10, "signup": 1}

REGISTRY_IDS = sorted(line.split("|")[1] for line in REGISTRY.splitlines())

# Categories of the part types when each part counts as an instrument.
PART_CATEGORIES = {
    "ECONOMY": "bond",
    "STANDARD": "forex",
    "PROMO": "crypto",
    "MEDIUM": "index",
    "LARGE": "commodity",
    "SMALL": "stock",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = events(spark, sf_dir).schema
    # The star lets the source take the table as one file or as a folder of files.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")


def raw_ticks(events: DataFrame, instrument: Column | None = None) -> DataFrame:
    """Raw ticks, one per event; the event type is the instrument unless another is given."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    offset = F.pmod(ms, F.lit(HOUR_MS))
    # A regex reads the one number in these flat objects four times as fast as a JSON parser.
    k = F.regexp_extract("props", r'"k"\s*:\s*(-?[0-9]+)', 1).cast("bigint")
    bid = F.floor(F.col("value") * 100 + 0.5)
    return events.select(
        (F.col("event_type") if instrument is None else instrument).alias("instrument"),
        F.timestamp_millis(ms - offset).alias("hour"),
        F.col("event_id").alias("seq"),
        offset.alias("ms_offset"),
        (bid + k).alias("ask_raw"),
        bid.alias("bid_raw"),
        (k / 8).cast("float").alias("ask_volume"),
        (F.col("user_id") % 64 / 4).cast("float").alias("bid_volume"),
    ).select(*RAW_TICKS.fieldNames())


def event_instruments(spark: SparkSession) -> DataFrame:
    lines = "\n".join(f"{name}|{factor}" for name, factor in EVENT_FACTORS.items())
    return lines_table(spark, lines, pa.schema([("id", pa.string()), ("decimal_factor", pa.int64())]))


def registry_instrument() -> Column:
    """A shipped instrument for each event, chosen by user."""
    ids = F.array(*[F.lit(i) for i in REGISTRY_IDS])
    return F.element_at(ids, (F.col("user_id") % len(REGISTRY_IDS) + 1).cast("int"))


def shard_instrument() -> Column:
    """Event type with a shard number, which bounds the ticks of one archive file."""
    return F.concat("event_type", F.lit("_"), F.call_function("div", "event_id", F.lit(SHARD_EVENTS)).cast("string"))


def part_id(part_key: str) -> Column:
    """Instrument id of a part."""
    return F.concat(F.lit("part"), F.col(part_key).cast("string"))


def part_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an instrument table: keys and ids differ, some first days and categories are unknown."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    category = F.col("p_type")
    for kind, name in PART_CATEGORIES.items():
        category = F.when(F.col("p_type") == kind, name).otherwise(category)
    category = F.when(F.col("p_size") % 10 == 9, "etf").when(F.col("p_size") % 10 == 8, "other").otherwise(category)
    first_day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") * 7 % 2400).cast("int"))
    rows = part.select(
        F.concat(F.lit("key"), F.col("p_partkey").cast("string")).alias("lookup_key"),
        part_id("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat("p_brand", F.lit(" "), "p_type").alias("description"),
        category.alias("category"),
        F.pow(F.lit(10.0), F.col("p_size") % 6).cast("bigint").alias("decimal_factor"),
        F.when(F.col("p_size") % 8 != 0, first_day.cast("timestamp")).alias("start_tick_date"),
    )
    return check_factors(rows.select(*INSTRUMENTS.fieldNames()))


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested range of one to three days per order, the customer being the instrument."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.to_date("o_orderdate")
    return orders.select(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string")).alias("instrument"),
        start.alias("start_date"),
        F.date_add(start, (F.col("o_orderkey") % 3).cast("int")).alias("end_date"),
    )


def lineitem_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested range per order line: the part is the instrument, the quantity the number of days."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.to_date("l_shipdate")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        part_id("l_partkey").alias("instrument"),
        start.alias("start_date"),
        F.date_add(start, F.col("l_quantity").cast("int")).alias("end_date"),
    )
