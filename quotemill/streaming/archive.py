"""Archive files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import FILE_SUFFIX, hour_from_path
from ..schemas import RAW_TICKS
from ..session import configure, tune_for_small_files
from ..sources.archive import decode_archive
from ..sources.tick_source import FORMAT, ROWS, register


def read_archive_stream(
    spark: SparkSession,
    root: str,
    on_error: str = "fail",
    max_files_per_trigger: int | None = None,
    schema: T.StructType = RAW_TICKS,
    manifest: DataFrame | None = None,
    partitions: int | None = None,
    lag_hours: int = 0,
) -> DataFrame:
    """Raw ticks of hour files as they land below ``root``, or with ``schema`` what ``decode_archive`` offers.

    The archive's own stream reader keeps the last hour of each instrument as its offset; see ``tick_source``, also for
    ``lag_hours``. Zero-length files are seen as in batch.

    ``manifest`` is a stream of rows (instrument, hour, path), such as a table that listings or requests are
    added to. Its files are opened by path in tasks, ``partitions`` of them; absent files are seen as well.

    With ``max_files_per_trigger`` Spark's file source finds the new files, in any order of landing. That source keeps
    their names on the driver and passes over zero-length files, so it is for small trees. A file that it found but that
    cannot be opened is faulty.
    """
    configure(spark)
    if manifest is not None:
        rows = manifest.repartition(partitions, "instrument", "hour") if partitions else manifest
        return decode_archive(rows, root, on_error, schema)
    if not max_files_per_trigger:
        register(spark)
        rows = next(name for name, kind in ROWS.items() if kind == schema)
        options = {"on_error": on_error, "rows": rows, "lag_hours": lag_hours}
        return spark.readStream.format(FORMAT).options(**options).load(root)
    tune_for_small_files(spark)
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{FILE_SUFFIX}")
    )
    reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    files = (
        reader.load(root)
        .select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+/[^/]+/[^/]+)$", 1).alias("path"))
        .withColumn("hour", hour_from_path("path"))
        .filter(F.col("hour").isNotNull())
        .withColumn("instrument", F.lower(F.substring_index("path", "/", 1)))
    )
    return decode_archive(files, root, on_error, schema, must_exist=True)
