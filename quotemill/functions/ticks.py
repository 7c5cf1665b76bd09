"""Columns derived from one tick."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid() -> Column:
    return (F.col("ask") + F.col("bid")) / F.lit(2.0)


def spread() -> Column:
    return F.col("ask") - F.col("bid")


def total_volume() -> Column:
    """Sum of both volumes in 32-bit precision, as the two inputs are; widen the result, not the inputs."""
    return F.col("ask_volume") + F.col("bid_volume")
