import json

import pytest
from helpers import at, rows
from pyspark.sql import functions as F

from quotemill import (
    by_category,
    category_stats,
    commodities,
    crypto,
    forex,
    get_instrument,
    has_data_for,
    indices,
    instrument_count,
    instrument_ids,
    instruments,
    list_instruments,
    search,
    stocks,
)


@pytest.fixture(scope="module")
def registry(spark):
    return instruments(spark).cache()


def test_registry_contents(registry):
    counts = {r["category"]: r["count"] for r in registry.groupBy("category").count().collect()}
    assert counts == {"forex": 28, "commodity": 6, "index": 6, "crypto": 4}
    factors = {r["decimal_factor"]: r["count"] for r in registry.groupBy("decimal_factor").count().collect()}
    assert factors == {100000: 22, 1000: 12, 10: 5, 100: 3, 10000: 1, 1: 1}
    first, last = registry.agg(F.min("start_tick_date").cast("string"), F.max("start_tick_date").cast("string")).first()
    assert (first, last) == ("2003-05-05 00:00:00", "2017-09-01 00:00:00")


@pytest.mark.parametrize("key", ["EURUSD", "EurUsd", "eurusd"])
def test_lookup_in_any_case(registry, key):
    row = get_instrument(registry, key).first()
    assert row["id"] == "eurusd" and row["decimal_factor"] == 100000


def test_lookup_is_by_key_not_id(registry):
    assert get_instrument(registry, "usaborrowusd").first()["id"] == "usatechidxusd"
    assert get_instrument(registry, "usatechidxusd").count() == 0


def test_categories(registry):
    sizes = [f(registry).count() for f in (forex, crypto, indices, stocks, commodities)]
    assert sizes == [28, 4, 6, 0, 6]
    assert by_category(registry, "FOREX").filter("category <> 'forex'").isEmpty()
    with pytest.raises(ValueError, match="unknown category"):
        by_category(registry, "fx")


def test_search(registry):
    euro = [r for r in registry.collect() if "eur" in r["id"] or "eur" in r["name"].lower()]
    assert search(registry, "eur").count() == len(euro) > 0
    assert {r["id"] for r in search(registry, "CRUDE").collect()} == {"uscrude", "ukcrude"}
    assert search(registry, "dow jones").count() == 0  # descriptions do not count
    assert search(registry, "%").count() == 0 and search(registry, "_").count() == 0
    assert search(registry, "").count() == 44


def test_listing(registry):
    assert list_instruments(registry, "crypto", "eur").count() == 4
    assert list_instruments(registry, None, "btc").count() == 1
    assert list_instruments(registry).count() == 44


def test_ids(registry):
    ids = [r[0] for r in instrument_ids(registry).collect()]
    assert ids == sorted(ids) and len(ids) == 44
    assert instrument_count(registry).first()[0] == 44


def test_has_data_for(spark):
    frame = spark.createDataFrame(
        [
            (at("2003-05-05"), at("2003-01-01")),
            (at("2003-05-05"), at("2024-01-01")),
            (at("2003-05-05"), at("2003-05-05")),
            (None, at("2024-01-01")),
        ],
        "start_tick_date timestamp, t timestamp",
    )
    assert [r[0] for r in frame.select(has_data_for("t")).collect()] == [False, True, True, False]


def test_registry_file(spark, tmp_path):
    path = tmp_path / "own.json"
    entry = {"id": "abc", "name": "A", "description": "d", "category": "bond", "decimal_factor": 10}
    path.write_text(json.dumps({"abc": {**entry, "start_tick_date": "2020-01-02T03:00:00Z"}, "xyz": entry}, indent=1))
    got = rows(instruments(spark, str(path)).withColumn("start_tick_date", F.col("start_tick_date").cast("string")))
    assert got == [
        ("abc", "abc", "A", "d", "bond", 10, "2020-01-02 03:00:00"),
        ("xyz", "abc", "A", "d", "bond", 10, None),
    ]


@pytest.mark.parametrize("factor", [0, None])
def test_bad_factor_fails(spark, tmp_path, factor):
    path = tmp_path / "own.json"
    path.write_text(json.dumps({"abc": {"id": "abc", "decimal_factor": factor}}))
    with pytest.raises(Exception, match="decimal factor must be positive: abc"):
        instruments(spark, str(path)).collect()


def test_broken_registry_file_fails(spark, tmp_path):
    path = tmp_path / "own.json"
    path.write_text("{not json")
    with pytest.raises(Exception):
        instruments(spark, str(path)).collect()


def test_category_stats(spark, tmp_path):
    stats = {r["category"]: tuple(r)[1:] for r in category_stats(spark).collect()}
    assert len(stats) == 7
    assert stats["forex"] == (75000, 5000, 2.5) and stats["crypto"] == (150000, 10000, 3.0)
    path = tmp_path / "stats.json"
    numbers = {"avg_compressed_bytes_per_hour": 1, "avg_ticks_per_hour": 2, "peak_multiplier": 1.5}
    path.write_text(json.dumps({"categories": {"bond": numbers}}))
    assert rows(category_stats(spark, str(path))) == [("bond", 1, 2, 1.5)]


def test_registry_is_small_enough_to_broadcast(spark):
    joined = spark.range(10).select(F.col("id").cast("string").alias("id")).join(instruments(spark), "id", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
