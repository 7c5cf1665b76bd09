"""Tick data and OHLCV bars on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Code for the Python workers travels with the tasks, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .functions import *  # noqa: E402,F401,F403
from .functions import __all__ as _functions
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _operators
from .plans import download, download_all
from .session import configure, local_session
from .sinks import parse_format, write_bar_documents, write_bars, write_tick_documents, write_ticks
from .sources import (
    category_stats,
    decode_archive,
    file_status,
    instruments,
    land_archive,
    list_archive,
    read_archive,
)
from .sources.archive import explode_batches
from .sources.run_table import land_run, landed_status, landed_ticks, publish_run
from .streaming import *  # noqa: F401,F403
from .streaming import __all__ as _streaming

__all__ = [
    *_functions,
    *_operators,
    *_streaming,
    "category_stats",
    "configure",
    "decode_archive",
    "download",
    "download_all",
    "explode_batches",
    "file_status",
    "instruments",
    "land_archive",
    "land_run",
    "landed_status",
    "landed_ticks",
    "list_archive",
    "local_session",
    "parse_format",
    "publish_run",
    "read_archive",
    "write_bar_documents",
    "write_bars",
    "write_tick_documents",
    "write_ticks",
]
