from .archive import read_archive_stream
from .bars import LateRows, fail_on_late_rows, merge_partial_bars, merge_parts, ohlcv_stream, partial_bars, write_partial_bars
from .compaction import read_partial_bars, vacuum_partial_bars, write_compacted_bars
from .keyed import closed_bars, use_keyed_state

__all__ = [
    "LateRows",
    "closed_bars",
    "fail_on_late_rows",
    "merge_partial_bars",
    "merge_parts",
    "ohlcv_stream",
    "partial_bars",
    "read_archive_stream",
    "read_partial_bars",
    "use_keyed_state",
    "vacuum_partial_bars",
    "write_compacted_bars",
    "write_partial_bars",
]
