from .coverage import coverage, coverage_by_instrument, overall_progress, pending, progress, run_totals
from .estimate import estimate, estimate_batch, estimate_lookbacks, peak_stats, with_category_stats
from .instruments import (
    CATEGORIES,
    by_category,
    commodities,
    crypto,
    forex,
    get_instrument,
    has_data_for,
    indices,
    instrument_count,
    instrument_ids,
    list_instruments,
    search,
    stocks,
)
from .normalize import normalize_ticks
from .ohlcv import bar_aggregates, coarser, ohlcv, ohlcv_cascade
from .ranges import expand, hour_ranges, missing_hours, pending_ranges, requested_ranges, without
from .requests import DEFAULT_START, hour_spine, manifest, requests, requests_totals

__all__ = [
    "CATEGORIES",
    "DEFAULT_START",
    "bar_aggregates",
    "by_category",
    "coarser",
    "commodities",
    "coverage",
    "coverage_by_instrument",
    "crypto",
    "estimate",
    "estimate_batch",
    "estimate_lookbacks",
    "expand",
    "forex",
    "get_instrument",
    "has_data_for",
    "hour_ranges",
    "hour_spine",
    "indices",
    "instrument_count",
    "instrument_ids",
    "list_instruments",
    "manifest",
    "missing_hours",
    "normalize_ticks",
    "ohlcv",
    "ohlcv_cascade",
    "overall_progress",
    "peak_stats",
    "pending",
    "pending_ranges",
    "progress",
    "requested_ranges",
    "requests",
    "requests_totals",
    "run_totals",
    "search",
    "stocks",
    "with_category_stats",
    "without",
]
