"""Tick archive: a tree of LZMA files, one per instrument and hour, of 20-byte big-endian records.

Files are named by rows (instrument, hour, path), so tasks open them by path and the driver never holds a
listing. A row comes either from a request manifest or from ``list_archive``, which lists in tasks as well.
"""

from __future__ import annotations

import datetime as dt
import lzma
import math
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import FILE_SUFFIX, TICK_BYTES, hour_from_path
from ..schemas import FILE_STATUS, RAW_TICKS
from ..session import configure, shared_dir, task_width

# The record layout of a decompressed file.
RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_vol", ">f4"), ("bid_vol", ">f4")])

FILES_PER_TASK = 2_000
MAX_TASKS = 100_000
OPEN_AHEAD = 8  # files a task reads ahead of the decoder
WHOLE_FILE_BYTES = 8 << 20  # larger files, and files that inflate past four times this, are streamed
HELD_BYTES = 256 << 20  # of a file that is kept while it is decoded, so that its second pass needs no storage
CHUNK_BYTES = 4 << 20
PAUSES = (0.2, 1.0)  # seconds before a task reads a file once more after a storage error
BATCH_ROWS = 65_536

# Tick rows and status rows in one table: a status is NULL in the former, the tick fields in the latter.
DECODED = T.StructType(RAW_TICKS.fields + [f for f in FILE_STATUS.fields if f.name not in ("instrument", "hour")])
_ARROW_TYPES = {
    "string": pa.string(),
    "timestamp": pa.timestamp("us", tz="UTC"),
    "bigint": pa.int64(),
    "float": pa.float32(),
}


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, _ARROW_TYPES[f.dataType.simpleString()]) for f in schema.fields])



class ArchiveFault(ValueError):
    """A file that is not a valid hour of ticks."""


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and base path of a local path or a URI."""
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:") :].lstrip("/")
    if "://" not in root:
        return pafs.LocalFileSystem(), root.rstrip("/")
    scheme, rest = root.split("://", 1)
    return pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest.rstrip('/')}")


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Decompressed pieces of bounded size; the stream must be complete."""
    decoder = lzma.LZMADecompressor(format=lzma.FORMAT_ALONE)
    seen = False
    for chunk in chunks:
        seen = seen or bool(chunk)
        try:
            piece = decoder.decompress(chunk, max_length=CHUNK_BYTES)
            while piece:
                yield piece
                piece = b"" if decoder.eof or decoder.needs_input else decoder.decompress(b"", max_length=CHUNK_BYTES)
        except lzma.LZMAError as exc:
            raise ArchiveFault(f"LZMA error: {exc}") from exc
        if decoder.eof:
            return
    raise ArchiveFault("LZMA error: truncated stream" if seen else "empty input")


def whole_records(pieces: Iterable[bytes]) -> Iterator[np.ndarray]:
    """Records of a payload that arrives in pieces."""
    rest, total = b"", 0
    for piece in pieces:
        total += len(piece)
        data = rest + piece
        cut = len(data) - len(data) % TICK_BYTES
        rest = data[cut:]
        if cut:
            yield np.frombuffer(data[:cut], dtype=RECORD)
    if rest:
        raise ArchiveFault(f"invalid data length: {total} bytes (expected a multiple of {TICK_BYTES})")


class _HourFile:
    """One archive file: read ahead while small, when it is decoded if larger, and in chunks if it is huge."""

    def __init__(self, store: pafs.FileSystem, path: str):
        self._store, self._path, self._data = store, path, None
        self.exists = True
        try:
            with store.open_input_file(path) as f:
                self._size = f.size()
                if self._size <= WHOLE_FILE_BYTES:
                    self._data = f.read()
        except FileNotFoundError:
            self.exists = False

    def _chunks(self) -> Iterator[bytes]:
        if self._data is None and self._size <= HELD_BYTES:
            with self._store.open_input_file(self._path) as f:
                self._data = f.read()
        if self._data is not None:
            yield self._data
            return
        with self._store.open_input_file(self._path) as f:
            while chunk := f.read(CHUNK_BYTES):
                yield chunk

    def records(self) -> Iterator[np.ndarray]:
        return whole_records(inflate(self._chunks()))


def _tried(read: Callable):
    """The result of a read, tried again after storage errors."""
    for pause in PAUSES:
        try:
            return read()
        except OSError:
            time.sleep(pause)
    return read()


def _read_hour(file: _HourFile) -> tuple[int, Iterable[np.ndarray]]:
    """Tick count and records, after the whole file proved valid: a faulty hour gives no tick at all."""
    kept: list[np.ndarray] | None = []
    n = size = 0
    for part in file.records():
        n += len(part)
        size += part.nbytes
        if kept is not None:
            kept.append(part)
            if size > 4 * WHOLE_FILE_BYTES:
                kept = None
    return n, (_again(file, n) if kept is None else kept)


def _again(file: _HourFile, n: int) -> Iterator[np.ndarray]:
    """The records once more; raises if they are not as many as before.

    Only a huge file is read from storage again. After a storage error that reading goes on behind the records given so
    far, since those cannot be taken back; if storage refuses for good, the task fails and Spark runs it again.
    """
    seen = 0
    for pause in (*PAUSES, None):
        skip = seen
        try:
            for part in file.records():
                if skip >= len(part):
                    skip -= len(part)
                    continue
                part, skip = part[skip:], 0
                seen += len(part)
                yield part
            break
        except OSError:
            if pause is None:
                raise
            time.sleep(pause)
    if seen != n:
        raise RuntimeError(f"file changed while it was read: {n} records, then {seen}")


def _tick_batches(schema: pa.Schema, instrument, hour, parts: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    seq = 0
    for part in parts:
        for at in range(0, len(part), BATCH_ROWS):
            rec = part[at : at + BATCH_ROWS]
            n = len(rec)
            columns = {
                "instrument": pa.repeat(instrument, n),
                "hour": pa.repeat(hour, n),
                "seq": pa.array(np.arange(seq, seq + n, dtype=np.int64)),
                "ms_offset": pa.array(rec["ms"].astype(np.int64)),
                "ask_raw": pa.array(rec["ask"].astype(np.int64)),
                "bid_raw": pa.array(rec["bid"].astype(np.int64)),
                "ask_volume": pa.array(rec["ask_vol"].astype(np.float32)),
                "bid_volume": pa.array(rec["bid_vol"].astype(np.float32)),
            }
            arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema]
            seq += n
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _status_batch(schema: pa.Schema, **row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(f.name)], type=f.type) for f in schema], schema=schema)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join small batches, since most hours hold a few thousand ticks."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH_ROWS:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def _decoder(root: str, on_error: str, schema: pa.Schema, must_exist: bool):
    ticks, statuses = "seq" in schema.names, "status" in schema.names

    def hours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch["instrument"], batch["hour"], batch["path"].to_pylist())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Future]]:
        """The rows with their files, of which some are opened ahead of the one that is decoded."""
        store, base = filesystem(root)
        ahead: deque[tuple[tuple, Future]] = deque()
        with ThreadPoolExecutor(OPEN_AHEAD) as pool:
            for row in hours(batches):
                ahead.append((row, pool.submit(_tried, lambda path=row[2]: _HourFile(store, f"{base}/{path}"))))
                if len(ahead) > OPEN_AHEAD:
                    yield ahead.popleft()
            while ahead:
                yield ahead.popleft()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (instrument, hour, path), opening in opened(batches):
            n, parts, status, error = 0, (), "no_data", None
            try:
                file = opening.result()
                if file.exists:
                    n, parts = _tried(lambda: _read_hour(file))
                    status = "ok" if n else "empty"
                elif must_exist:
                    raise ArchiveFault("the file was found but cannot be opened")
            except (ArchiveFault, OSError) as exc:
                if on_error == "fail":
                    raise ArchiveFault(f"{path}: {exc}") from exc
                status, error = "error", str(exc)
            if ticks:
                yield from _tick_batches(schema, instrument, hour, parts)
            if statuses:
                yield _status_batch(
                    schema, instrument=instrument, hour=hour, path=path, status=status, n_ticks=n, error=error
                )

    return lambda batches: _grouped(decode(batches))


def spread_files(files: DataFrame, partitions: int | None = None, ordered: bool = False) -> DataFrame:
    """Spread file rows over tasks.

    The rows are tiny next to the files behind them, so the partition count is set from the number of files;
    left to adaptive execution they would be merged into a few tasks by their own size. Counting runs the plan
    of ``files`` once more, so give ``partitions``, or a stored table, where that plan is costly. ``ordered`` gives
    each task files that follow each other.
    """
    if partitions is None:
        n = files.count()
        floor = min(n, files.sparkSession.sparkContext.defaultParallelism)
        partitions = max(1, floor, min(MAX_TASKS, math.ceil(n / FILES_PER_TASK)))
    rows = files.select("instrument", "hour", "path")
    if ordered:
        return rows.repartitionByRange(partitions, "instrument", "hour").sortWithinPartitions("instrument", "hour")
    return rows.repartition(partitions, "instrument", "hour")


def decode_archive(
    files: DataFrame, root: str, on_error: str = "skip", schema: T.StructType = DECODED, must_exist: bool = False
) -> DataFrame:
    """Open and decode the files named by rows (instrument, hour, path), in the partitions as they are.

    ``RAW_TICKS`` gives the ticks, ``FILE_STATUS`` one row per file, and ``DECODED`` both in one table, where
    ticks have no status. The status is ``ok``, ``empty`` (no record), ``no_data`` (no such file) or, with
    ``on_error="skip"``, ``error``; with ``"fail"`` a faulty file fails the job. A file that storage refuses is
    read a few times and then counts as faulty. ``must_exist`` is for rows that come from a listing: there a
    missing file is a faulty one.
    """
    if on_error not in ("fail", "skip"):
        raise ValueError(f"on_error must be 'fail' or 'skip', not {on_error!r}")
    decoder = _decoder(root, on_error, _arrow_schema(schema), must_exist)
    return files.select("instrument", "hour", "path").mapInArrow(decoder, schema)


def _list_children(root: str, depth: int):
    """Directories ``depth`` levels below each given relative directory, or its hour files for depth None."""

    def walk(store, base, rel, levels) -> Iterator[str]:
        selector = pafs.FileSelector(f"{base}/{rel}".rstrip("/"), allow_not_found=True)
        for info in store.get_file_info(selector):
            if info.type == pafs.FileType.Directory:
                child = f"{rel}/{info.base_name}".lstrip("/")
                if levels == 1:
                    yield child
                else:
                    yield from walk(store, base, child, levels - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        for batch in batches:
            for rel in batch["dir"].to_pylist():
                found = list(walk(store, base, rel, depth))
                if found:
                    yield pa.RecordBatch.from_pydict({"dir": found})

    return run


def _list_files(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        for batch in batches:
            for rel in batch["dir"].to_pylist():
                selector = pafs.FileSelector(f"{base}/{rel}", allow_not_found=True)
                found = [
                    (f"{rel}/{info.base_name}", info.size)
                    for info in store.get_file_info(selector)
                    if info.type == pafs.FileType.File and info.base_name.endswith(FILE_SUFFIX)
                ]
                if found:
                    paths, sizes = zip(*found)
                    yield pa.RecordBatch.from_pydict(
                        {"path": pa.array(paths), "length": pa.array(sizes, type=pa.int64())}
                    )

    return run


def list_archive(spark: SparkSession, root: str) -> DataFrame:
    """Hour files below ``root`` as (instrument, hour, path, length), zero-length files included.

    Tasks list: one finds the instruments, then one task per instrument its days, then tasks share the days.
    """
    configure(spark)
    width = task_width(spark)
    top = spark.range(1, numPartitions=1).select(F.lit("").alias("dir"))
    names = top.mapInArrow(_list_children(root, 1), "dir string").repartition(width, "dir")
    days = names.mapInArrow(_list_children(root, 3), "dir string").repartition(width, "dir")
    found = days.mapInArrow(_list_files(root), "path string, length bigint")
    return (
        found.withColumn("hour", hour_from_path("path"))
        .filter(F.col("hour").isNotNull())
        .select(F.lower(F.substring_index("path", "/", 1)).alias("instrument"), "hour", "path", "length")
    )


def _files(spark: SparkSession, root: str, manifest: DataFrame | None, partitions: int | None) -> DataFrame:
    configure(spark)
    if manifest is None:
        # Kept as a table, so that counting and decoding do not list the tree twice.
        listing = shared_dir(spark, "listing")
        list_archive(spark, root).write.parquet(listing)
        manifest = spark.read.parquet(listing)
    return spread_files(manifest, partitions)


def read_archive(
    spark: SparkSession,
    root: str,
    on_error: str = "fail",
    manifest: DataFrame | None = None,
    partitions: int | None = None,
    *,
    instruments: Iterable[str] | None = None,
    first_hour: dt.datetime | None = None,
    last_hour: dt.datetime | None = None,
) -> DataFrame:
    """Raw ticks of the hours in ``manifest``, or of the files below ``root``.

    Without a manifest, files of other instruments and hours than the asked ones are neither listed nor opened, so nothing
    in them can fail the read. Both ends count. A read of the whole archive lists it in tasks.
    """
    if manifest is None and (instruments is not None or first_hour is not None or last_hour is not None):
        from .tick_source import FORMAT, register

        register(configure(spark))
        asked = {"on_error": on_error, "instruments": None if instruments is None else ",".join(instruments)}
        asked |= {name: hour and hour.isoformat() for name, hour in (("first_hour", first_hour), ("last_hour", last_hour))}
        return spark.read.format(FORMAT).options(**{k: v for k, v in asked.items() if v is not None}).load(root)
    files = _files(spark, root, manifest, partitions)
    return decode_archive(files, root, on_error, RAW_TICKS)


def file_status(
    spark: SparkSession, root: str, manifest: DataFrame | None = None, partitions: int | None = None
) -> DataFrame:
    """Status and tick count of each file, without moving the ticks out of the decoder."""
    files = _files(spark, root, manifest, partitions)
    return decode_archive(files, root, "skip", FILE_STATUS)


def land_archive(
    spark: SparkSession,
    root: str,
    out: str,
    on_error: str = "skip",
    manifest: DataFrame | None = None,
    partitions: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Decode once into a Parquet table at ``out``; returns its raw ticks and its file statuses.

    Decompression dominates, so work that needs both, or needs the ticks more than once, starts from here.
    """
    files = _files(spark, root, manifest, partitions)
    decode_archive(files, root, on_error).write.parquet(out)
    landed = spark.read.schema(DECODED).parquet(out)
    is_tick = F.col("status").isNull()
    return (
        landed.filter(is_tick).select(*RAW_TICKS.fieldNames()),
        landed.filter(~is_tick).select(*FILE_STATUS.fieldNames()),
    )


def explode_batches(batches: DataFrame) -> DataFrame:
    """Single ticks from rows that hold an hour's ticks in an array column ``ticks``; other columns stay."""
    others = [c for c in batches.columns if c != "ticks"]
    return batches.select(*others, F.inline("ticks"))
