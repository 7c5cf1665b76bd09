"""Writes raw ticks as an archive tree, to have files for the archive reader."""

from __future__ import annotations

import lzma
import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import archive_path
from ..session import task_width
from ..sources.archive import RECORD, filesystem

# What the writer can do to an hour's file.
FAULTS = ("bad_length", "zero_length", "garbage", "empty", "unreadable")

# LZMA preset with a small dictionary: the files are small and many.
_FILTERS = [{"id": lzma.FILTER_LZMA1, "preset": 0, "dict_size": 1 << 16}]


class _Output:
    """One file, compressed while it is written and moved into place when complete."""

    def __init__(self, store, path: str, fault: str | None):
        self._store, self._path, self._fault = store, path, fault
        store.create_dir(posixpath.dirname(path), recursive=True)
        self._temporary = posixpath.join(posixpath.dirname(path), f"_{uuid.uuid4().hex}")
        self._out = store.open_output_stream(self._temporary)
        self._codec = lzma.LZMACompressor(format=lzma.FORMAT_ALONE, filters=_FILTERS)

    def add(self, records: bytes) -> None:
        if self._fault in (None, "bad_length"):
            self._out.write(self._codec.compress(records))

    def close(self) -> None:
        if self._fault == "bad_length":
            self._out.write(self._codec.compress(b"\0\0\0\0\0"))
        if self._fault == "garbage":
            self._out.write(b"\0\1\2\3")
        elif self._fault != "zero_length":
            self._out.write(self._codec.flush())
        self._out.close()
        if self._fault == "unreadable":  # storage refuses to open a folder
            self._store.delete_file(self._temporary)
            self._store.create_dir(self._path)
        else:
            self._store.move(self._temporary, self._path)


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(root)
        current, out, files = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rec = np.empty(batch.num_rows, dtype=RECORD)
            for field, name in zip(RECORD.names, ("ms_offset", "ask_raw", "bid_raw", "ask_volume", "bid_volume")):
                rec[field] = batch[name].to_numpy(zero_copy_only=False)
            runs = pc.run_end_encode(batch["path"])
            start = 0
            for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if path != current:
                    if out:
                        out.close()
                    current, files = path, files + 1
                    out = _Output(store, posixpath.join(base, path), batch["fault"][start].as_py())
                out.add(rec[start:end].tobytes())
                start = end
        if out:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], type=pa.int64())})

    return write


def write_archive(raw: DataFrame, root: str, fault: Column | None = None) -> int:
    """Write raw ticks below ``root``, records of a file in (ms_offset, seq) order; returns the file count.

    Rows of a file meet in one task, which compresses them as they come and never holds a file in memory.
    """
    width = task_width(raw.sparkSession)
    rows = (
        raw.withColumn("path", archive_path("instrument", "hour"))
        .withColumn("fault", F.lit(None).cast("string") if fault is None else fault)
        .repartition(width, "path")
        .sortWithinPartitions("path", "ms_offset", "seq")
        .select("path", "fault", "ms_offset", "ask_raw", "bid_raw", "ask_volume", "bid_volume")
    )
    return rows.mapInArrow(_writer(root), "files bigint").agg(F.sum("files")).first()[0]
