"""Partial bars in tiers: the parts that micro-batches add are merged, so that their number stays logarithmic.

Each micro-batch adds a part of level 0. Where a level has ``ratio`` parts, they are merged into one of the next level,
which keeps the orders of open and close and so can be merged again. A list names the parts that are live; a new list is
renamed into place after its parts are whole, so readers see all of a change or none, and parts that are merged stay
readable for those who hold an older list until ``vacuum_partial_bars`` is called.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql import types as T

from ..schemas import BARS
from .bars import merge_parts, partial_bars

LISTS = "_live"
RATIO = 8
PARTS = T.StructType([*BARS.fields, T.StructField("open_order", T.LongType()), T.StructField("close_order", T.LongType())])


class LiveParts:
    """The live parts that one streaming query has written below ``path``."""

    def __init__(self, spark: SparkSession, path: str, query: str):
        self.spark, self.path, self.query = spark, path, query
        self.folder = self._hadoop(f"{path}/{LISTS}/{query}")
        self.store = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        """Published lists, each named by the last batch it covers."""
        if not self.store.exists(self.folder):
            return []
        names = [status.getPath().getName() for status in self.store.listStatus(self.folder)]
        return sorted(int(name) for name in names if name.isdecimal())

    def read(self, version: int | None = None) -> list[dict]:
        """Parts as {level, first, last}, batches in order."""
        known = self.versions()
        if not known:
            return []
        data = self.store.open(self._hadoop(f"{self.folder}/{known[-1] if version is None else version}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8"))
        finally:
            data.close()

    def publish(self, parts: list[dict]) -> None:
        draft, final = self._hadoop(f"{self.folder}/.draft"), self._hadoop(f"{self.folder}/{parts[-1]['last']}")
        out = self.store.create(draft, True)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if not self.store.rename(draft, final):
            raise RuntimeError(f"the list of parts could not be renamed to {final}")

    def where(self, part: dict) -> str:
        return f"{self.path}/query={self.query}/part={part['level']}-{part['first']}-{part['last']}"

    def add(self, bars: DataFrame, batch: int, ratio: int) -> None:
        """Add a batch's partial bars. A batch that a list covers already was whole, so its repetition adds nothing."""
        parts = self.read()
        if parts and batch <= parts[-1]["last"]:
            return
        parts.append({"level": 0, "first": batch, "last": batch})
        bars.write.mode("overwrite").parquet(self.where(parts[-1]))
        level = 0
        while len(same := [part for part in parts if part["level"] == level]) >= ratio:
            merged = {"level": level + 1, "first": same[0]["first"], "last": same[-1]["last"]}
            rows = bars.sparkSession.read.schema(bars.schema).parquet(*map(self.where, same))
            merge_parts(rows).write.mode("overwrite").parquet(self.where(merged))
            parts = sorted([part for part in parts if part not in same] + [merged], key=lambda part: part["first"])
            level += 1
        self.publish(parts)


def write_compacted_bars(ticks: DataFrame, timeframe: str, path: str, ratio: int = RATIO, wide_seq: bool = False) -> DataStreamWriter:
    """Like ``write_partial_bars``, with parts merged in tiers of ``ratio``. Several streams can add to one table."""
    if ratio < 2:
        raise ValueError("a tier has two parts at least")

    def store(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not query:
            raise RuntimeError("the batch does not tell its query")
        LiveParts(batch.sparkSession, path, query).add(partial_bars(batch, timeframe, wide_seq), batch_id, ratio)

    return ticks.writeStream.foreachBatch(store)


def _tables(spark: SparkSession, path: str) -> list[LiveParts]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{LISTS}")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    return [LiveParts(spark, path, status.getPath().getName()) for status in store.listStatus(folder)]


def read_partial_bars(spark: SparkSession, path: str) -> DataFrame:
    """Partial bars of the live parts, for ``merge_partial_bars``."""
    paths = [table.where(part) for table in _tables(spark, path) for part in table.read()]
    return spark.read.parquet(*paths) if paths else spark.createDataFrame([], PARTS)


def vacuum_partial_bars(spark: SparkSession, path: str) -> int:
    """Delete parts and lists that the newest lists no longer name; returns the number of parts. Not for use beside a writer."""
    gone = 0
    for table in _tables(spark, path):
        live = {table.where(part).rsplit("/", 1)[-1] for part in table.read()}
        for status in table.store.listStatus(table._hadoop(f"{path}/query={table.query}")):
            if status.getPath().getName() not in live:
                gone += table.store.delete(status.getPath(), True)
        for version in table.versions()[:-1]:
            table.store.delete(table._hadoop(f"{table.folder}/{version}"), False)
    return gone
