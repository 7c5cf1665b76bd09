"""Average size statistics per instrument category."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CATEGORY_STATS
from .registry import lines_table

# Category, average compressed bytes per hour, average ticks per hour, peak multiplier.
STATS = """\
forex|75000|5000|2.5
crypto|150000|10000|3.0
index|50000|3000|2.0
commodity|40000|2500|2.0
stock|30000|2000|1.5
etf|25000|1500|1.5
bond|20000|1000|1.5"""

# The same three numbers for a category that has no statistics.
DEFAULT_STATS = {
    "avg_compressed_bytes_per_hour": 50000,
    "avg_ticks_per_hour": 3000,
    "peak_multiplier": 2.0,
}

_COLUMNS = pa.schema(
    [
        ("category", pa.string()),
        ("avg_compressed_bytes_per_hour", pa.int64()),
        ("avg_ticks_per_hour", pa.int64()),
        ("peak_multiplier", pa.float64()),
    ]
)
_JSON = (
    "struct<categories: map<string, struct<avg_compressed_bytes_per_hour: bigint, "
    "avg_ticks_per_hour: bigint, peak_multiplier: double>>>"
)


def category_stats(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The shipped statistics, or those of a JSON file ``{"categories": {name: {...}}}``."""
    if path is None:
        return lines_table(spark, STATS, _COLUMNS)
    entries = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", _JSON, {"mode": "FAILFAST"}).getField("categories"))
    )
    return entries.select(F.col("key").alias("category"), "value.*").select(*CATEGORY_STATS.fieldNames())
