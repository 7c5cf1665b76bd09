from .bars import bar_metrics
from .paths import archive_path, hour_from_path, ticks_in_payload
from .ticks import mid, spread, total_volume
from .time import TIMEFRAMES, bar_start, in_range, parse_timeframe, timeframe_seconds

__all__ = [
    "TIMEFRAMES",
    "archive_path",
    "bar_metrics",
    "bar_start",
    "hour_from_path",
    "in_range",
    "mid",
    "parse_timeframe",
    "spread",
    "ticks_in_payload",
    "timeframe_seconds",
    "total_volume",
]
