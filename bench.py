"""Times the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Every query is run in full into Spark's noop
sink; queries that write or stream do so as part of their run. The value is the sum over all queries of the
better of two runs, after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotemill.queries import queries  # noqa: E402
from quotemill.session import local_session  # noqa: E402

HEADLINE = (
    "S1_archive_scan",
    "S3_file_status",
    "P1_normalize",
    "P1_normalize_registry",
    "A1_ohlcv_s1",
    "A1_ohlcv_m1",
    "A1_ohlcv_h1",
    "A1_ohlcv_h4",
    "A1_ohlcv_d1",
    "A2_registry_bars_h1",
    "A3_tick_bars",
    "P9_typical_price",
    "T2_bar_start",
    "T3_hour_spine",
    "F5_has_data_for",
    "F6_in_range",
    "C1_manifest",
    "C2_coverage_by_instrument",
    "C3_pending",
    "A2_download_all_h1",
    "S2_strict_scan",
    "R2_stream_archive_bars",
    "E1_estimate",
    "E4_estimate_lookbacks",
    "K1_csv_ticks",
    "K5_json_ticks",
    "K6_parquet_ticks",
    "R1_stream_bars",
    "R3_stream_flush",
)


def run_once(query, spark, sf_dir: str) -> float:
    began = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    known = queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        run_once(known[name], spark, sf_dir)
        times[name] = round(min(run_once(known[name], spark, sf_dir) for _ in range(2)), 4)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": {n: round(events / times[n]) for n in ("S1_archive_scan", "P1_normalize", "A1_ohlcv_h4")},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
