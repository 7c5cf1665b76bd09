"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir

#: Characters that one step in a task works on at a time, where it holds several arrays per character.
STEP_CHARS = 1_000_000
#: Bytes of a batch that goes to a Python worker. The executor and the worker hold several copies of one.
BATCH_BYTES = 8 << 20


def steady(spark: SparkSession) -> None:
    """Hold batches for Python workers to BATCH_BYTES, where the session does not hold them to less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = str(spark.conf.get(key)).lower().removesuffix("b")
    if not given.isdigit() or int(given) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    steady(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_is(key: str, divisor: int, value: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor == value, F.lit(False))


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again, so that later work does not repeat what made them."""
    spark = df.sparkSession
    steady(spark)
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(keys: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Settled keys for a join: broadcast where a count shows that they are few, else for Spark to shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def bounded_ids(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` keys, the smallest by hash: the same ones for the same rows in any order."""
    keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
    return keys.orderBy(F.xxhash64(key), key).limit(limit)


def steps(batch: pa.RecordBatch, column: str, size: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``size`` bytes together, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(lengths):
        return
    block = (np.cumsum(lengths, dtype=np.int64) - lengths) // size
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], len(lengths)], strict=True):
        yield batch.slice(int(start), int(stop - start))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [value or "" for value in batch.column(column).to_pylist()]


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split()


def rest() -> None:
    """At the end of a task: hands freed memory back, since the worker lives on beside others and may wait for long."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone keeps so much
        trim(0)


def with_struct(
    df: DataFrame, name: str, fields: T.StructType, make: Callable[[pa.RecordBatch], list], column: str = "text", size: int = STEP_CHARS
) -> DataFrame:
    """The rows with a struct column that ``make`` computes from slices of the batches; all other columns pass unchanged."""
    steady(df.sparkSession)
    schema = T.StructType([field for field in df.schema.fields if field.name != name] + [T.StructField(name, fields)])
    kept = [field.name for field in schema.fields[:-1]]
    names, kinds = fields.names, [arrow_type(field.dataType) for field in fields.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, column, size):
                made = [pa.array(values, kind) for values, kind in zip(make(part), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.StructArray.from_arrays(made, names)], [*kept, name])
        rest()

    return df.mapInArrow(run, schema)


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, arrow_type(field.dataType)) for field in kind.fields])
    return {
        "string": pa.string(),
        "bigint": pa.int64(),
        "int": pa.int32(),
        "double": pa.float64(),
        "boolean": pa.bool_(),
        "binary": pa.binary(),
    }[kind.simpleString()]
