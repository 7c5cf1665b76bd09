"""Raw archive records to quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TICKS

HOUR_MS = 3_600_000
SEQ_PER_FILE = 1 << 24
WIDE_SEQ_PER_FILE = 1 << 40  # an offset reaches over its hour by some thousand hours, so numbers stay below 2^51


def normalize_ticks(raw: DataFrame, instruments: DataFrame, wide_seq: bool = False) -> DataFrame:
    """Absolute times and real prices from raw ticks and the instruments' decimal factors.

    The join is by instrument id. The planner broadcasts the instrument table when its size allows; a larger
    one is joined by a shuffle, where adaptive execution splits a hot instrument. An unknown instrument fails
    the job rather than lose its ticks.

    The millisecond offset may reach beyond the file's hour, into times that later files cover. Such a tick
    counts as earlier than theirs: its sequence number is lowered by a file's worth per hour it is over. A file's worth
    are 2^24 records, so that numbers fit beside the time in the narrow order of ``ohlcv``; a tick that is over its hour
    and beyond them raises. ``wide_seq`` makes it 2^40, more than any file holds; bars of such ticks take
    ``wide_seq=True`` as well.

    Instruments that share an id count once; where their factors differ, their ticks raise.
    """
    factors = instruments.groupBy(F.col("id").alias("instrument")).agg(
        F.min("decimal_factor").alias("decimal_factor"), F.max("decimal_factor").alias("other_factor")
    )
    differ = F.raise_error(F.concat(F.lit("different decimal factors of instrument: "), F.col("instrument")))
    unknown = F.raise_error(F.concat(F.lit("unknown instrument: "), F.col("instrument"))).cast("double")
    one = F.when(F.col("decimal_factor") == F.col("other_factor"), F.col("decimal_factor").cast("double"))
    factor = F.coalesce(one, F.when(F.col("decimal_factor").isNotNull(), differ.cast("double")), unknown)
    over = F.call_function("div", "ms_offset", F.lit(HOUR_MS))
    worth = WIDE_SEQ_PER_FILE if wide_seq else SEQ_PER_FILE
    far = F.raise_error(F.format_string("tick %s of %s at %s is over its hour; use wide_seq=True", "seq", "instrument", F.col("hour").cast("string")))
    seq = F.when((over == 0) | (F.col("seq") < worth), F.col("seq") - over * F.lit(worth)).otherwise(far.cast("bigint"))
    return (
        raw.join(factors, "instrument", "left")
        .withColumn("seq", seq)
        .withColumn("timestamp", F.timestamp_millis(F.unix_millis("hour") + F.col("ms_offset")))
        .withColumn("ask", F.col("ask_raw").cast("double") / factor)
        .withColumn("bid", F.col("bid_raw").cast("double") / factor)
        .select(*TICKS.fieldNames())
    )
