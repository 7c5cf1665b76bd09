"""The archive as a data source of Spark: ``spark.read`` and ``spark.readStream`` with the format ``tick_archive``.

Batch: only folders of the asked instruments and days are listed, and tasks open only files of the asked hours. So a fault
elsewhere in the archive does not fail a strict read of one instrument. The planner keeps days with their bytes, never
files, and shares days out by bytes. What is asked for are options of the source, not filters pushed into it: Spark 4.1 keeps
the filters that a Python source took in one plan for other plans over the same frame, which then lose rows.

Stream: the offset is the last hour found of each instrument, so that instruments that land later are read from their start,
and neither the driver nor the checkpoint keeps names of files. To find it only the newest folders are listed; tasks list
the days between two offsets. An hour that lands behind the last one of its instrument is not seen any more: ``lag_hours``
holds the offset back by some hours where files land out of order, and ``pending`` finds what is missing at any time.

Options: ``on_error`` (``fail`` or ``skip``) and ``rows`` (``ticks``, ``status`` or ``both``) as for ``decode_archive``;
``instruments`` (ids with commas between), ``first_hour`` and ``last_hour`` (ISO texts in UTC, both included) for batch reads;
``lag_hours`` for streams.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from ..functions.paths import FILE_SUFFIX
from ..schemas import FILE_STATUS, RAW_TICKS
from .archive import DECODED, _arrow_schema, _decoder, filesystem

FORMAT = "tick_archive"
ROWS = {"ticks": RAW_TICKS, "status": FILE_STATUS, "both": DECODED}

TASK_BYTES = 32 << 20  # compressed bytes of a task's days
MAX_TASKS = 100_000
MONTH_HOURS = 744  # of a stream's task
LISTERS = 16  # folders listed at a time
HOUR = dt.timedelta(hours=1)
UTC = dt.timezone.utc
FIRST, LAST = dt.datetime(1, 1, 2, tzinfo=UTC), dt.datetime(9999, 12, 30, tzinfo=UTC)


def as_utc(value: dt.datetime) -> dt.datetime:
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


@dataclass
class Days(InputPartition):
    """Folders of days, and the hours that are asked for in them; both ends count."""

    folders: list[str]
    first: dt.datetime
    last: dt.datetime


class Tree:
    """Listings of an archive, several at a time."""

    def __init__(self, root: str):
        self.store, self.base = filesystem(root)

    def _entries(self, folder: str) -> list[pafs.FileInfo]:
        return self.store.get_file_info(pafs.FileSelector(f"{self.base}/{folder}".rstrip("/"), allow_not_found=True))

    def folders(self, folder: str) -> list[str]:
        return sorted(f"{folder}/{info.base_name}".lstrip("/") for info in self._entries(folder) if info.type == pafs.FileType.Directory)

    def hours(self, folder: str) -> dict[dt.datetime, tuple[str, int]]:
        """Path and length of a day's files by their hours."""
        found = {}
        for info in self._entries(folder):
            hour = hour_of(f"{folder}/{info.base_name}") if info.type == pafs.FileType.File else None
            if hour is not None:
                found[hour] = f"{folder}/{info.base_name}", info.size
        return found

    def instruments(self, names: set[str] | None) -> list[str]:
        return [folder for folder in self.folders("") if names is None or folder.lower() in names]

    def days(self, instrument: str, first: dt.datetime, last: dt.datetime) -> list[str]:
        """Folders of days with an hour from the first to the last one; years and months outside are not listed."""
        out = []
        for year in self.folders(instrument):
            if spans(year, first, last):
                for month in self.folders(year):
                    if spans(month, first, last):
                        out += [day for day in self.folders(month) if spans(day, first, last)]
        return out

    def newest(self, folder: str, depth: int = 3) -> dt.datetime | None:
        """The last hour below a folder, by its newest folders alone."""
        if not depth:
            return max(self.hours(folder), default=None)
        for child in sorted(self.folders(folder), key=_number, reverse=True):
            if (found := self.newest(child, depth - 1)) is not None:
                return found
        return None


def _number(folder: str) -> int:
    name = folder.rsplit("/", 1)[-1]
    return int(name) if name.isdecimal() else -1


def day_of(folder: str) -> tuple[dt.datetime, dt.datetime] | None:
    """First and last hour of a folder instrument/year[/month - 1[/day]]; None where it names no time."""
    parts = folder.split("/")[1:]
    if not parts or not all(part.isdecimal() for part in parts):
        return None
    year, month, day = (int(part) for part in (parts + ["0", "1"][len(parts) - 1 :])[:3])
    try:
        start = dt.datetime(year, month + 1, day, tzinfo=UTC)
        if len(parts) == 3:
            end = start + dt.timedelta(days=1)
        else:
            end = dt.datetime(year + (len(parts) == 1 or month == 11), (month + 1) % 12 + 1 if len(parts) == 2 else 1, 1, tzinfo=UTC)
    except (ValueError, OverflowError):
        return None
    return start, end - HOUR


def spans(folder: str, first: dt.datetime, last: dt.datetime) -> bool:
    ends = day_of(folder)
    return ends is not None and ends[0] <= last and ends[1] >= first


def hour_of(path: str) -> dt.datetime | None:
    folder, name = path.rsplit("/", 1)
    ends, hour = day_of(folder), name.removesuffix(FILE_SUFFIX)
    if ends is None or folder.count("/") != 3 or not name.endswith(FILE_SUFFIX) or not hour.isdecimal() or int(hour) > 23:
        return None
    return ends[0] + int(hour) * HOUR


def read_days(root: str, days: Days, on_error: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of the asked files in some days, which the task lists itself."""
    tree = Tree(root)

    def files() -> Iterator[pa.RecordBatch]:
        for folder in days.folders:
            found = sorted((hour, path) for hour, (path, _) in tree.hours(folder).items() if days.first <= hour <= days.last)
            if found:
                hours, paths = zip(*found, strict=True)
                names = [folder.split("/", 1)[0].lower()] * len(found)
                yield pa.RecordBatch.from_pydict({"instrument": pa.array(names), "hour": pa.array(hours, pa.timestamp("us", "UTC")), "path": pa.array(paths)})

    yield from _decoder(root, on_error, _arrow_schema(schema), must_exist=True)(files())


class ArchiveReader(DataSourceReader):
    def __init__(self, root: str, on_error: str, schema: T.StructType, names: set[str] | None, first: dt.datetime, last: dt.datetime):
        self.root, self.on_error, self.schema = root, on_error, schema
        self.names, self.first, self.last = names, first, last

    def partitions(self) -> Sequence[InputPartition]:
        tree = Tree(self.root)
        with ThreadPoolExecutor(LISTERS) as pool:
            below = pool.map(lambda name: tree.days(name, self.first, self.last), tree.instruments(self.names))
            days = [day for found in below for day in found]
            sizes = list(pool.map(lambda day: sum(size for _, size in tree.hours(day).values()), days))
        share = max(TASK_BYTES, sum(sizes) // MAX_TASKS)
        tasks: list[list[str]] = []
        room = 0
        for day, size in zip(days, sizes, strict=True):
            if not tasks or size > room:
                tasks.append([])
                room = share
            tasks[-1].append(day)
            room -= size
        return [Days(task, self.first, self.last) for task in tasks or [[]]]  # without a partition Spark asks to read none

    def read(self, partition: Days) -> Iterator[pa.RecordBatch]:
        return read_days(self.root, partition, self.on_error, self.schema)


class ArchiveStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, on_error: str, schema: T.StructType, lag: int):
        self.root, self.on_error, self.schema, self.lag = root, on_error, schema, lag * HOUR

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        tree = Tree(self.root)
        with ThreadPoolExecutor(LISTERS) as pool:
            names = tree.instruments(None)
            return {name: (hour - self.lag).isoformat() for name, hour in zip(names, pool.map(tree.newest, names), strict=True) if hour is not None}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        """A task reads a month of an instrument at most."""
        tree, tasks = Tree(self.root), []
        for name, until in end.items():
            first = dt.datetime.fromisoformat(start[name]) + HOUR if name in start else FIRST
            last = dt.datetime.fromisoformat(until)
            days = tree.days(name, first, last) if first <= last else []
            step = MONTH_HOURS // 24
            for at in range(0, len(days), step):
                tasks.append(Days(days[at : at + step], first, last))
        return tasks or [Days([], FIRST, FIRST)]

    def read(self, partition: Days) -> Iterator[pa.RecordBatch]:
        return read_days(self.root, partition, self.on_error, self.schema)


class TickArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        rows = self.options.get("rows", "ticks")
        if rows not in ROWS:
            raise ValueError(f"rows must be one of {', '.join(ROWS)}, not {rows!r}")
        return ROWS[rows]

    def _given(self, schema: T.StructType) -> tuple:
        on_error = self.options.get("on_error", "fail")
        if on_error not in ("fail", "skip"):
            raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error!r}")
        return self.options["path"], on_error, schema

    def reader(self, schema: T.StructType) -> ArchiveReader:
        names = self.options.get("instruments")
        asked = None if names is None else {name.strip().lower() for name in names.split(",")}
        ends = [as_utc(dt.datetime.fromisoformat(self.options[key])) if key in self.options else end for key, end in (("first_hour", FIRST), ("last_hour", LAST))]
        return ArchiveReader(*self._given(schema), asked, *ends)

    def streamReader(self, schema: T.StructType) -> ArchiveStreamReader:
        return ArchiveStreamReader(*self._given(schema), int(self.options.get("lag_hours", 0)))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(TickArchive)
