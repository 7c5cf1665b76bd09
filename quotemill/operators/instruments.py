"""Selections from an instrument table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The instrument categories.
CATEGORIES = ("forex", "crypto", "index", "stock", "commodity", "etf", "bond")


def get_instrument(instruments: DataFrame, key: str) -> DataFrame:
    """The instrument with a lookup key, in any case."""
    return instruments.filter(F.col("lookup_key") == key.lower())


def by_category(instruments: DataFrame, category: str) -> DataFrame:
    name = category.lower()
    if name not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}, expected one of: {', '.join(CATEGORIES)}")
    return instruments.filter(F.col("category") == name)


def forex(instruments: DataFrame) -> DataFrame:
    return by_category(instruments, "forex")


def crypto(instruments: DataFrame) -> DataFrame:
    return by_category(instruments, "crypto")


def indices(instruments: DataFrame) -> DataFrame:
    return by_category(instruments, "index")


def stocks(instruments: DataFrame) -> DataFrame:
    return by_category(instruments, "stock")


def commodities(instruments: DataFrame) -> DataFrame:
    return by_category(instruments, "commodity")


def search(instruments: DataFrame, pattern: str) -> DataFrame:
    """Instruments whose id or name holds the pattern as plain text, in any case."""
    wanted = F.lit(pattern.lower())
    return instruments.filter(F.contains(F.lower("id"), wanted) | F.contains(F.lower("name"), wanted))


def list_instruments(
    instruments: DataFrame, category: str | None = None, pattern: str | None = None
) -> DataFrame:
    """By category if one is given, else by pattern if one is given, else all."""
    if category is not None:
        return by_category(instruments, category)
    if pattern is not None:
        return search(instruments, pattern)
    return instruments


def has_data_for(ts: Column | str, start: Column | str = "start_tick_date") -> Column:
    """Whether ticks exist at a time; an unknown first day means no."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    start = F.col(start) if isinstance(start, str) else start
    return F.coalesce(ts >= start, F.lit(False))


def instrument_ids(instruments: DataFrame) -> DataFrame:
    """All lookup keys in ascending order."""
    return instruments.select("lookup_key").orderBy("lookup_key")


def instrument_count(instruments: DataFrame) -> DataFrame:
    return instruments.agg(F.count(F.lit(1)).alias("n_instruments"))
