from .archive import decode_archive, file_status, land_archive, list_archive, read_archive
from .category_stats import DEFAULT_STATS, category_stats
from .registry import instruments

__all__ = [
    "DEFAULT_STATS",
    "category_stats",
    "decode_archive",
    "file_status",
    "instruments",
    "land_archive",
    "list_archive",
    "read_archive",
]
