"""One JSON document per instrument."""

import json
import os

import pytest
from helpers import rows, ticks
from pyspark.sql import functions as F

from quotemill import ohlcv, write_bar_documents, write_tick_documents


@pytest.fixture
def many(spark):
    """A hot instrument over several tasks, and small ones."""
    return (
        spark.range(20_000, numPartitions=6)
        .select(
            F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 3)).alias("instrument"),
            F.timestamp_millis(F.xxhash64("id") % 1_000_000_000).alias("timestamp"),
            F.col("id").alias("seq"),
            F.rand(1).alias("ask"),
            F.when(F.col("id") == 1, float("nan")).otherwise(F.rand(2)).alias("bid"),
        )
        .withColumns({c: F.lit(1.0).cast("float") for c in ("ask_volume", "bid_volume")})
    )


@pytest.mark.parametrize("pretty", [False, True])
def test_each_instrument_is_one_array_in_time_order(spark, many, tmp_path, pretty):
    out = str(tmp_path / "some" / "docs")
    keys = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    old = [spark.conf.get(key) for key in keys]
    try:
        spark.conf.set(keys[0], "100k")
        spark.conf.set(keys[1], "1")
        counts = write_tick_documents(many, out, pretty)
    finally:
        for key, value in zip(keys, old, strict=True):
            spark.conf.set(key, value)
    assert sorted(n for n in os.listdir(out) if n[0] != ".") == ["hot.json", "i0.json", "i1.json", "i2.json"]
    assert {r.instrument: r.rows for r in counts.collect()} == {r.instrument: r["count"] for r in many.groupBy("instrument").count().collect()}
    for name in ("hot", "i1"):
        got = json.load(open(f"{out}/{name}.json"))
        want = many.filter(F.col("instrument") == name).orderBy("timestamp", "seq").collect()
        assert [row["ask"] for row in got] == [row.ask for row in want]
    assert sum(row["bid"] is None for row in json.load(open(f"{out}/hot.json"))) == 1
    assert os.listdir(tmp_path / "some") == ["docs"]


def test_a_failed_write_leaves_nothing(spark, many, tmp_path):
    bad = many.withColumn("ask", F.when(F.col("seq") == 19_999, F.raise_error(F.lit("broken tick")).cast("double")).otherwise(F.col("ask")))
    with pytest.raises(Exception, match="broken tick"):
        write_tick_documents(bad, str(tmp_path / "docs"))
    assert os.listdir(tmp_path) == []


def test_bars_and_no_rows(spark, tmp_path):
    some = ticks(spark, ("eurusd", "2024-01-01 12:00:00", 2.0, 2.0), ("eurusd", "2024-01-01 13:00:00", 3.0, 3.0))
    counts = write_bar_documents(ohlcv(some, "h1"), str(tmp_path / "bars"))
    assert rows(counts) == [("eurusd", 2)]
    assert [bar["open"] for bar in json.load(open(tmp_path / "bars" / "eurusd.json"))] == [2.0, 3.0]
    assert write_tick_documents(some.filter("false"), str(tmp_path / "none")).count() == 0
    assert [name for name in os.listdir(tmp_path / "none") if name[0] != "."] == []
    with pytest.raises(ValueError, match="output path exists"):
        write_bar_documents(ohlcv(some, "h1"), str(tmp_path / "bars"))
