import glob
import json
import math
import os
import random
import struct

import pyarrow.parquet as pq
import pytest
from helpers import ticks
from pyspark.sql import functions as F

from quotemill import ohlcv, parse_format, write_bars, write_ticks
from quotemill.sinks import plain_number

ROWS = (
    ("2024-01-15 12:30:45", 1.1001, 1.1000),
    ("2024-01-15 12:30:46.250", 100.0, 0.00001),
)


def parts(path, pattern="part-*"):
    return sorted(glob.glob(os.path.join(path, "**", pattern), recursive=True))


def text(path):
    return "".join(open(p, encoding="utf-8").read() for p in parts(path))


@pytest.fixture
def two(spark):
    return ticks(spark, *ROWS).coalesce(1)


def test_csv_ticks(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two, out, "csv", partition_by_instrument=False)
    assert text(out) == (
        "timestamp,ask,bid,ask_volume,bid_volume\n"
        "2024-01-15T12:30:45.000Z,1.1001,1.1,100,100\n"
        "2024-01-15T12:30:46.250Z,100,0.00001,100,100\n"
    )


def test_csv_bars(two, tmp_path):
    out = str(tmp_path / "o")
    write_bars(ohlcv(two, "h1"), out, "csv", partition_by_instrument=False)
    assert text(out).splitlines() == [
        "timestamp,open,high,low,close,volume,tick_count",
        "2024-01-15T12:00:00Z,1.10005,50.000005,1.10005,50.000005,400,2",
    ]


def test_csv_options(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two, out, "CSV", delimiter="\t", header=False, partition_by_instrument=False)
    assert text(out).splitlines()[0] == "2024-01-15T12:30:45.000Z\t1.1001\t1.1\t100\t100"


@pytest.mark.parametrize(
    "value, shown",
    [
        (0.0, "0"),
        (-0.0, "-0"),
        (1e-5, "0.00001"),
        (-1.25e-7, "-0.000000125"),
        (1e7, "10000000"),
        (1.2345678e7, "12345678"),
        (123456789.125, "123456789.125"),
        (-1.5e20, "-150000000000000000000"),
        (0.001, "0.001"),
        (1.1001, "1.1001"),
        (float("nan"), "NaN"),
        (float("inf"), "inf"),
        (float("-inf"), "-inf"),
    ],
)
def test_plain_number(spark, value, shown):
    assert spark.createDataFrame([(value,)], "x double").select(plain_number("x")).first()[0] == shown


def test_plain_numbers_read_back_exactly(spark):
    rng = random.Random(13)
    values = [struct.unpack(">d", rng.randbytes(8))[0] for _ in range(3000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 16) for _ in range(3000)]
    values = [v for v in values if math.isfinite(v)]
    frame = spark.createDataFrame([(v,) for v in values], "x double").select("x", plain_number("x").alias("t"))
    for value, shown in frame.collect():
        assert "E" not in shown and not shown.endswith(".0") and float(shown) == value


def test_plain_float(spark):
    frame = spark.createDataFrame([(0.1,), (1e10,)], "x float").select(plain_number("x"))
    assert [r[0] for r in frame.collect()] == ["0.1", "10000000000"]


def test_ndjson(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two, out, "jsonl", partition_by_instrument=False)
    lines = text(out).splitlines()
    assert all(line.startswith("{") for line in lines)
    assert json.loads(lines[0]) == {
        "timestamp": "2024-01-15T12:30:45Z",
        "ask": 1.1001,
        "bid": 1.1,
        "ask_volume": 100.0,
        "bid_volume": 100.0,
    }
    assert json.loads(lines[1])["timestamp"] == "2024-01-15T12:30:46.250Z"


def test_numbers_that_are_not_finite_are_null_in_json(two, tmp_path):
    odd = two.withColumn("ask_volume", F.lit(float("nan")).cast("float")).withColumn("bid", F.lit(float("inf")))
    for name in ("ndjson", "json"):
        out = str(tmp_path / name)
        write_ticks(odd, out, name, partition_by_instrument=False)
        content = text(out)
        first = json.loads(content.splitlines()[0]) if name == "ndjson" else json.loads(content)[0]
        assert first["ask_volume"] is None and first["bid"] is None and "ask" in first


def test_json_array(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two, out, "json", partition_by_instrument=False)
    assert text(out).startswith("[")
    assert [r["ask"] for r in json.loads(text(out))] == [1.1001, 100.0]


def test_pretty_json(two, tmp_path):
    out = str(tmp_path / "o")
    write_bars(ohlcv(two, "s1"), out, "json", pretty=True, partition_by_instrument=False, ordered=True)
    files = [open(p).read() for p in parts(out)]
    assert any('\n    "open"' in f for f in files)
    bars = [b for f in files for b in json.loads(f)]
    assert [b["timestamp"] for b in bars] == ["2024-01-15T12:30:45Z", "2024-01-15T12:30:46Z"]
    assert list(bars[0]) == ["timestamp", "open", "high", "low", "close", "volume", "tick_count"]


@pytest.mark.parametrize("ordered", [False, True])
def test_json_documents_per_instrument(spark, tmp_path, ordered):
    """Every file is one array in time order; a document may span many Arrow batches."""
    n = 25_000
    frame = spark.range(n).select(
        F.concat(F.lit("i"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).cast("string")).alias("instrument"),
        F.timestamp_millis(F.col("id") * 250).alias("timestamp"),
        F.col("id").alias("seq"),
        F.col("id").cast("double").alias("ask"),
        F.col("id").cast("double").alias("bid"),
        F.lit(1.0).cast("float").alias("ask_volume"),
        F.lit(1.0).cast("float").alias("bid_volume"),
    )
    out = str(tmp_path / "o")
    write_ticks(frame.repartition(5), out, "json", ordered=ordered)
    seen = []
    for path in parts(out):
        asks = [r["ask"] for r in json.load(open(path))]
        assert asks == sorted(asks) and asks
        name = os.path.basename(os.path.dirname(path)).removeprefix("instrument=")
        assert {("i0" if a % 3 == 0 else f"i{int(a) % 5}") for a in asks} == {name}
        seen += asks
    assert sorted(seen) == [float(i) for i in range(n)]


@pytest.mark.parametrize("name", ["csv", "json", "parquet"])
def test_a_hot_instrument_is_split_over_files(spark, tmp_path, name):
    """One instrument holds most rows: several tasks write it, each file sorted, and small ones stay whole."""
    n = 60_000
    frame = (
        spark.range(n, numPartitions=8)
        .select(
            F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 4)).alias("instrument"),
            F.timestamp_millis(F.xxhash64("id") % 1_000_000_000).alias("timestamp"),
            F.col("id").alias("seq"),
            F.rand(1).alias("ask"),
            F.rand(2).alias("bid"),
        )
        .withColumns({c: F.lit(1.0).cast("float") for c in ("ask_volume", "bid_volume")})
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "200k")
    try:
        out = str(tmp_path / "o")
        write_ticks(frame, out, name)
    finally:
        spark.conf.set(key, old)
    assert len(parts(os.path.join(out, "instrument=hot"))) > 1
    back = {"csv": lambda: spark.read.csv(out, header=True), "parquet": lambda: spark.read.parquet(out)}
    read = back.get(name, lambda: spark.read.json(out, multiLine=True))()
    assert read.count() == n
    assert read.filter("instrument = 'hot'").count() == n - n // 3
    if name == "csv":
        for path in parts(out):
            times = [line.split(",")[0] for line in open(path).read().splitlines()[1:]]
            assert times == sorted(times)


def test_empty_output_is_an_empty_array(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two.filter("ask < 0"), out, "json", partition_by_instrument=False)
    assert all(json.load(open(p)) == [] for p in parts(out))


def test_parquet(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two, out, "pq", partition_by_instrument=False)
    (path,) = parts(out, "*.parquet")
    assert open(path, "rb").read(4) == b"PAR1" and ".snappy." in path
    schema = pq.read_schema(path)
    assert [(f.name, str(f.type)) for f in schema] == [
        ("timestamp", "timestamp[us, tz=UTC]"),
        ("ask", "double"),
        ("bid", "double"),
        ("ask_volume", "float"),
        ("bid_volume", "float"),
    ]
    bars = str(tmp_path / "b")
    write_bars(ohlcv(two, "d1"), bars, "parquet", partition_by_instrument=False, compression="zstd")
    (path,) = parts(bars, "*.parquet")
    assert ".zstd." in path and len(pq.read_schema(path)) == 7


def test_row_groups(spark, two, tmp_path):
    many = spark.range(1000).crossJoin(two.limit(1)).drop("id").coalesce(1)
    out = str(tmp_path / "o")
    write_ticks(many, out, "parquet", row_group_rows=100, partition_by_instrument=False)
    (path,) = parts(out, "*.parquet")
    assert pq.ParquetFile(path).num_row_groups == 10


def test_one_output_per_instrument(spark, tmp_path):
    frame = ticks(spark, ("a", "2024-01-01", 1.0, 1.0), ("b", "2024-01-01", 2.0, 2.0), ("a", "2024-01-02", 3.0, 3.0))
    out = str(tmp_path / "o")
    write_ticks(frame, out, "csv")
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["instrument=a", "instrument=b"]
    assert len(parts(out)) == 2
    assert open(parts(out)[0]).read().count("\n") == 3


def test_format_names():
    assert [parse_format(n) for n in ("csv", "JSON", "ndjson", "jsonl", "parquet", "PQ")] == [
        "csv",
        "json",
        "ndjson",
        "ndjson",
        "parquet",
        "parquet",
    ]
    with pytest.raises(ValueError, match="unknown format"):
        parse_format("xlsx")


def test_existing_output_is_kept_unless_asked(two, tmp_path):
    out = str(tmp_path / "o")
    write_ticks(two, out)
    with pytest.raises(Exception, match="already exists"):
        write_ticks(two, out)
    write_ticks(two, out, mode="overwrite")
