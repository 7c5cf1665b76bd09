"""Columns derived from one bar."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bar_metrics(bars: DataFrame) -> DataFrame:
    """Add range, body, direction flags, typical price and weighted close to bars."""
    o, h, lo, c = (F.col(n) for n in ("open", "high", "low", "close"))
    return bars.withColumns(
        {
            "range": h - lo,
            "body": F.abs(c - o),
            "is_bullish": c > o,
            "is_bearish": c < o,
            "typical_price": (h + lo + c) / F.lit(3.0),
            "weighted_close": (h + lo + F.lit(2.0) * c) / F.lit(4.0),
        }
    )
