from .documents import write_bar_documents, write_tick_documents
from .writers import FORMATS, format_name, parse_format, plain_number, write_bars, write_ticks

__all__ = [
    "FORMATS",
    "format_name",
    "parse_format",
    "plain_number",
    "write_bar_documents",
    "write_bars",
    "write_tick_documents",
    "write_ticks",
]
