"""Instrument reference table."""

from __future__ import annotations

import io

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INSTRUMENTS
from ..session import configure

# Lookup key, id, name, description, category, decimal factor, first day with ticks.
# One key differs from its id: usaborrowusd.
REGISTRY = """\
eurusd|eurusd|EUR/USD|Euro vs US Dollar|forex|100000|2003-05-05
gbpusd|gbpusd|GBP/USD|British Pound vs US Dollar|forex|100000|2003-05-05
usdjpy|usdjpy|USD/JPY|US Dollar vs Japanese Yen|forex|1000|2003-05-05
usdchf|usdchf|USD/CHF|US Dollar vs Swiss Franc|forex|100000|2003-05-05
audusd|audusd|AUD/USD|Australian Dollar vs US Dollar|forex|100000|2003-08-03
usdcad|usdcad|USD/CAD|US Dollar vs Canadian Dollar|forex|100000|2003-08-03
nzdusd|nzdusd|NZD/USD|New Zealand Dollar vs US Dollar|forex|100000|2003-08-03
eurgbp|eurgbp|EUR/GBP|Euro vs British Pound|forex|100000|2003-08-03
eurjpy|eurjpy|EUR/JPY|Euro vs Japanese Yen|forex|1000|2003-08-03
eurchf|eurchf|EUR/CHF|Euro vs Swiss Franc|forex|100000|2003-08-03
gbpjpy|gbpjpy|GBP/JPY|British Pound vs Japanese Yen|forex|1000|2003-08-03
gbpchf|gbpchf|GBP/CHF|British Pound vs Swiss Franc|forex|100000|2003-08-03
chfjpy|chfjpy|CHF/JPY|Swiss Franc vs Japanese Yen|forex|1000|2003-08-03
euraud|euraud|EUR/AUD|Euro vs Australian Dollar|forex|100000|2005-10-30
eurcad|eurcad|EUR/CAD|Euro vs Canadian Dollar|forex|100000|2005-10-30
eurnzd|eurnzd|EUR/NZD|Euro vs New Zealand Dollar|forex|100000|2005-10-30
gbpaud|gbpaud|GBP/AUD|British Pound vs Australian Dollar|forex|100000|2005-10-30
gbpcad|gbpcad|GBP/CAD|British Pound vs Canadian Dollar|forex|100000|2005-10-30
gbpnzd|gbpnzd|GBP/NZD|British Pound vs New Zealand Dollar|forex|100000|2005-10-30
audcad|audcad|AUD/CAD|Australian Dollar vs Canadian Dollar|forex|100000|2005-10-30
audchf|audchf|AUD/CHF|Australian Dollar vs Swiss Franc|forex|100000|2005-10-30
audjpy|audjpy|AUD/JPY|Australian Dollar vs Japanese Yen|forex|1000|2005-10-30
audnzd|audnzd|AUD/NZD|Australian Dollar vs New Zealand Dollar|forex|100000|2005-10-30
cadjpy|cadjpy|CAD/JPY|Canadian Dollar vs Japanese Yen|forex|1000|2005-10-30
cadchf|cadchf|CAD/CHF|Canadian Dollar vs Swiss Franc|forex|100000|2005-10-30
nzdjpy|nzdjpy|NZD/JPY|New Zealand Dollar vs Japanese Yen|forex|1000|2005-10-30
nzdcad|nzdcad|NZD/CAD|New Zealand Dollar vs Canadian Dollar|forex|100000|2005-10-30
nzdchf|nzdchf|NZD/CHF|New Zealand Dollar vs Swiss Franc|forex|100000|2005-10-30
xauusd|xauusd|XAU/USD|Gold vs US Dollar|commodity|1000|2004-05-05
xagusd|xagusd|XAG/USD|Silver vs US Dollar|commodity|1000|2004-05-05
btcusd|btcusd|BTC/USD|Bitcoin vs US Dollar|crypto|100|2017-01-01
ethusd|ethusd|ETH/USD|Ethereum vs US Dollar|crypto|100|2017-06-01
ltcusd|ltcusd|LTC/USD|Litecoin vs US Dollar|crypto|100|2017-07-01
xrpusd|xrpusd|XRP/USD|Ripple vs US Dollar|crypto|100000|2017-09-01
usa500idxusd|usa500idxusd|US 500|S&P 500 Index|index|10|2013-05-05
usa30idxusd|usa30idxusd|US 30|Dow Jones Industrial Average|index|10|2013-05-05
usaborrowusd|usatechidxusd|US Tech 100|NASDAQ 100 Index|index|10|2013-05-05
deuidxeur|deuidxeur|Germany 40|DAX 40 Index|index|10|2013-05-05
gbridxgbp|gbridxgbp|UK 100|FTSE 100 Index|index|10|2013-05-05
jpnidxjpy|jpnidxjpy|Japan 225|Nikkei 225 Index|index|1|2013-05-05
uscrude|uscrude|WTI Crude Oil|West Texas Intermediate Crude Oil|commodity|1000|2013-05-05
ukcrude|ukcrude|Brent Crude Oil|Brent Crude Oil|commodity|1000|2013-05-05
natgas|natgas|Natural Gas|Natural Gas|commodity|1000|2013-05-05
copper|copper|Copper|Copper|commodity|10000|2013-05-05"""

_COLUMNS = pa.schema(
    [
        ("lookup_key", pa.string()),
        ("id", pa.string()),
        ("name", pa.string()),
        ("description", pa.string()),
        ("category", pa.string()),
        ("decimal_factor", pa.int64()),
        ("start_tick_date", pa.date32()),
    ]
)
_JSON = (
    "map<string, struct<id: string, name: string, description: string, category: string, "
    "decimal_factor: bigint, start_tick_date: string>>"
)


def lines_table(spark: SparkSession, text: str, columns: pa.Schema) -> DataFrame:
    """Rows of a ``|``-separated text as a local relation: the planner knows its size, so joins broadcast it."""
    table = csv.read_csv(
        io.BytesIO(text.encode()),
        read_options=csv.ReadOptions(column_names=columns.names),
        parse_options=csv.ParseOptions(delimiter="|"),
        convert_options=csv.ConvertOptions(column_types=columns),
    )
    return spark.createDataFrame(table)


def instruments(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The shipped registry, or one read from a JSON object keyed by lookup key.

    A decimal factor of zero or less would make every price meaningless, so such a row fails the read.
    """
    configure(spark)
    if path is None:
        rows = lines_table(spark, REGISTRY, _COLUMNS)
    else:
        entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", _JSON, {"mode": "FAILFAST"})))
        rows = entries.select(F.col("key").alias("lookup_key"), "value.*")
    start = F.col("start_tick_date").cast("timestamp")
    return check_factors(rows.withColumn("start_tick_date", start).select(*INSTRUMENTS.fieldNames()))


def check_factors(rows: DataFrame) -> DataFrame:
    """Fail on a missing or non-positive decimal factor."""
    bad = F.raise_error(F.concat(F.lit("decimal factor must be positive: "), F.col("id")))
    factor = F.col("decimal_factor")
    return rows.withColumn("decimal_factor", F.when(factor > 0, factor).otherwise(bad.cast("bigint")))
