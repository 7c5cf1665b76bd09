"""One JSON array per instrument, however many tasks write it.

Rows are dealt by ranges of (instrument, time). Tasks write fragments, rows with commas between, through a data source whose
commit lists them and whose abort removes them; fragments of attempts that failed are never listed. One task per instrument
then copies its fragments into one document, a piece at a time. The folder of documents is renamed into place at the end, so
a run that fails leaves nothing to see.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import configure, setting
from ..sources.archive import filesystem
from .writers import BAR_FIELDS, TICK_FIELDS, json_text

FORMAT = "json_fragments"
LISTING = "listing.json"
PIECE_BYTES = 4 << 20


@dataclass
class Fragments(WriterCommitMessage):
    """What a task wrote: instrument, place of the task, file and rows."""

    files: list[dict] = field(default_factory=list)


class FragmentWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Fragments:
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        done, out = Fragments(), None
        for batch in iterator:
            if not batch.num_rows:
                continue
            runs, start = pc.run_end_encode(batch.column("instrument")), 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                texts, start = batch.column("value").slice(start, end - start), end
                if not done.files or done.files[-1]["instrument"] != name:
                    if out:
                        out.close()
                    file = f"{context.partitionId()}-{context.taskAttemptId()}-{len(done.files)}"
                    done.files.append({"instrument": name, "place": context.partitionId(), "file": file, "rows": 0})
                    out = store.open_output_stream(posixpath.join(base, file))
                elif len(texts):
                    out.write(b",\n")
                out.write(",\n".join(texts.to_pylist()).encode())
                done.files[-1]["rows"] += len(texts)
        if out:
            out.close()
        return done

    def commit(self, messages: list[Fragments | None]) -> None:
        store, base = filesystem(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(posixpath.join(base, LISTING)) as out:
            for message in messages:
                for file in message.files if message else ():
                    out.write(json.dumps(file).encode() + b"\n")

    def abort(self, messages: list[Fragments | None]) -> None:
        store, base = filesystem(self.path)
        store.delete_dir_contents(base, missing_dir_ok=True)


class JsonFragments(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: T.StructType, overwrite: bool) -> FragmentWriter:
        return FragmentWriter(self.options["path"])


def _join(path: str, out: str):
    """Copies an instrument's fragments, in order, into its document."""

    def run(files: pa.Table) -> pa.Table:
        store, base = filesystem(path)
        to, folder = filesystem(out)
        name, rows = files.column("instrument")[0].as_py(), files.sort_by("place").to_pylist()
        to.create_dir(folder, recursive=True)
        draft, final = f"{folder}/_{uuid.uuid4().hex}", f"{folder}/{name}.json"
        with to.open_output_stream(draft) as target:
            target.write(b"[\n")
            for i, row in enumerate(rows):
                target.write(b",\n" if i else b"")
                with store.open_input_stream(f"{base}/{row['file']}") as source:
                    while piece := source.read(PIECE_BYTES):
                        target.write(piece)
            target.write(b"\n]\n")
        to.move(draft, final)
        return pa.table({"instrument": [name], "rows": pa.array([sum(row["rows"] for row in rows)], pa.int64())})

    return run


def _write(df: DataFrame, fields, order: list[str], path: str, pretty: bool) -> DataFrame:
    spark = configure(df.sparkSession)
    store, target = _hadoop(spark, path)
    if store.exists(target):
        raise ValueError(f"output path exists: {path}")
    work = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    spark.dataSource.register(JsonFragments)
    rows = df.repartitionByRange("instrument", *order).sortWithinPartitions("instrument", *order)
    texts = rows.select("instrument", json_text(fields, pretty).alias("value"))
    try:
        with setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
            texts.write.format(FORMAT).mode("append").option("path", f"{work}/fragments").save()
        listed = spark.read.schema("instrument string, place int, file string, rows bigint").json(f"{work}/fragments/{LISTING}")
        # As many rows as tasks and instruments; instruments are dealt out so that big documents do not wait for each other.
        done = listed.groupBy("instrument").applyInArrow(_join(f"{work}/fragments", f"{work}/documents"), "instrument string, rows bigint")
        written = done.collect()  # one row per document
        made = _hadoop(spark, f"{work}/documents")[1]
        store.mkdirs(made)
        if target.getParent():
            store.mkdirs(target.getParent())
        if not store.rename(made, target):
            raise RuntimeError(f"the documents could not be moved to {path}")
    finally:
        store.delete(_hadoop(spark, work)[1], True)
    return spark.createDataFrame(written, "instrument string, rows bigint")


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_tick_documents(ticks: DataFrame, path: str, pretty: bool = False) -> DataFrame:
    """Write ``<path>/<instrument>.json``, one array of all its ticks in time order; returns the rows of each document."""
    return _write(ticks, TICK_FIELDS, ["timestamp", "seq"], path, pretty)


def write_bar_documents(bars: DataFrame, path: str, pretty: bool = False) -> DataFrame:
    """As ``write_tick_documents`` for bars."""
    return _write(bars, BAR_FIELDS, ["timestamp"], path, pretty)
