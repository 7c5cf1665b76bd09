"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..operators.estimate import COMPRESSION_RATIO, FULL_HISTORY, LOOKBACKS
from ..sources.category_stats import DEFAULT_STATS, STATS
from ..sources.registry import REGISTRY
from . import frames as fr
from . import registered as q

BAR_SECONDS = {"s1": 1, "m1": 60, "m5": 300, "m15": 900, "m30": 1800, "h1": 3600, "h4": 14400, "d1": 86400}
# Seconds of q.TIMEFRAME_ALIASES, in their order.
ALIAS_TIMEFRAMES = ("s1", "m1", "m5", "m15", "m30", "h1", "h4", "d1")

_FACTOR = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {f}" for n, f in fr.EVENT_FACTORS.items()) + " END"
_IDS = "[" + ", ".join(f"'{i}'" for i in fr.REGISTRY_IDS) + "]"


def _registry_rows() -> str:
    def row(line: str) -> str:
        key, ident, name, text, category, factor, first = line.split("|")
        return f"('{key}', '{ident}', '{name}', '{text}', '{category}', {factor}::BIGINT, TIMESTAMP '{first}')"

    return ",\n".join(row(line) for line in REGISTRY.splitlines())


def _stats_rows() -> str:
    rows = (line.split("|") for line in STATS.splitlines())
    return ", ".join(f"('{c}', {b}::BIGINT, {t}::BIGINT, {p}::DOUBLE)" for c, b, t, p in rows)


REGISTRY_CTE = f"""registry(lookup_key, id, name, description, category, decimal_factor, start_tick_date)
  AS (VALUES {_registry_rows()})"""

STATS_CTE = f"stats(category, bytes, ticks, peak) AS (VALUES {_stats_rows()})"

# Every event as a raw tick; the instrument expression varies.


def _raw_cte(instrument: str = "event_type", factor: str = _FACTOR) -> str:
    return f"""raw AS (
  SELECT {instrument} AS instrument, event_id AS seq, epoch_us(ts) // 1000 AS ms, user_id, event_type,
         CAST(round(value * 100) AS BIGINT) AS bid_raw,
         CAST(round(value * 100) AS BIGINT) + CAST(props->>'$.k' AS BIGINT) AS ask_raw,
         CAST(props->>'$.k' AS BIGINT) AS k,
         CAST(CAST(props->>'$.k' AS BIGINT) / 8 AS FLOAT) AS ask_volume,
         CAST((user_id % 64) / 4 AS FLOAT) AS bid_volume,
         CAST({factor} AS DOUBLE) AS factor
  FROM events)"""


_TICKS_CTE = """ticks AS (
  SELECT instrument, seq, ms, make_timestamp(ms * 1000) AS timestamp, ask_raw / factor AS ask,
         bid_raw / factor AS bid, ask_volume, bid_volume, (ask_raw / factor + bid_raw / factor) / 2 AS mid,
         CAST(CAST(ask_volume + bid_volume AS FLOAT) AS DOUBLE) AS vol
  FROM raw)"""

TICKS = f"WITH {_raw_cte()}, {_TICKS_CTE}"
RAW = f"WITH {_raw_cte()}"

_REGISTRY_INSTRUMENT = f"list_extract({_IDS}, CAST(user_id % {len(fr.REGISTRY_IDS)} AS INTEGER) + 1)"
REGISTRY_TICKS = f"""WITH {REGISTRY_CTE}, {_raw_cte(_REGISTRY_INSTRUMENT, "NULL").replace("raw AS", "raw0 AS", 1)},
raw AS (SELECT raw0.* REPLACE (CAST(r.decimal_factor AS DOUBLE) AS factor)
        FROM raw0 JOIN registry r ON r.id = raw0.instrument), {_TICKS_CTE}"""

TICK_ROWS = """SELECT instrument, timestamp, seq, ask, bid, CAST(ask_volume AS DOUBLE) AS ask_volume,
       CAST(bid_volume AS DOUBLE) AS bid_volume FROM ticks"""
WRITTEN_TICKS = """SELECT instrument, timestamp, ask, bid, CAST(ask_volume AS DOUBLE) AS ask_volume,
       CAST(bid_volume AS DOUBLE) AS bid_volume FROM ticks"""


def _bars(seconds: int, source: str = "ticks") -> str:
    width = seconds * 1000
    return f"""SELECT instrument, make_timestamp(ms // {width} * {width} * 1000) AS timestamp,
       first(mid ORDER BY ms, seq) AS open, max(mid) AS high, min(mid) AS low,
       last(mid ORDER BY ms, seq) AS close, sum(vol) AS volume, count(*) AS tick_count
FROM {source} GROUP BY 1, 2"""


def _csv_lines(delimiter: str, header: bool) -> str:
    """Ticks as text lines: times with milliseconds, numbers without a zero fraction."""

    def number(name: str) -> str:
        small = f"rtrim(printf('%.5f', {name}), '0')"  # the finest factor has five decimals
        return f"CASE WHEN {name} > 0 AND {name} < 0.001 THEN {small} ELSE regexp_replace(CAST({name} AS VARCHAR), '\\.0$', '') END"

    tab = f"E'{delimiter}'"
    time = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%gZ')"
    line = f" || {tab} || ".join([time, *map(number, ("ask", "bid", "ask_volume", "bid_volume"))])
    head = " UNION ALL SELECT DISTINCT instrument, 'timestamp,ask,bid,ask_volume,bid_volume' FROM ticks" if header else ""
    return f"{TICKS} SELECT instrument, {line} AS line FROM ticks{head}"


def _metric(name: str, expression: str) -> str:
    return f"{TICKS} SELECT instrument, timestamp, {expression} AS {name} FROM ({_bars(1800)})"


# Events as an archive: type and shard are the instrument, files hold records in (time, event) order.

_SHARD = f"event_type || '_' || (event_id // {fr.SHARD_EVENTS})"
_SHARD_TICKS = f"""WITH {_raw_cte(_SHARD)},
archived AS (
  SELECT instrument, make_timestamp(ms // 3600000 * 3600000000) AS hour, ms // 3600000 % 24 AS hour_of_day,
         row_number() OVER (PARTITION BY instrument, ms // 3600000 ORDER BY ms, seq) - 1 AS seq,
         ms % 3600000 AS ms_offset, ask_raw, bid_raw, CAST(ask_volume AS DOUBLE) AS ask_volume,
         CAST(bid_volume AS DOUBLE) AS bid_volume
  FROM raw)"""
_DAMAGED = ", ".join(str(h) for h in q.FAULT_BY_HOUR)
_HOUR_OF = {fault: hour for hour, fault in q.FAULT_BY_HOUR.items()}
_ARCHIVED_ROWS = """SELECT instrument, hour, seq, ms_offset, ask_raw, bid_raw, ask_volume, bid_volume
FROM archived"""
_FILES = f"""{_SHARD_TICKS},
path_of AS (
  SELECT instrument, hour, any_value(hour_of_day) AS hour_of_day, count(*) AS n,
         upper(instrument) || '/' || strftime(hour, '%Y') || '/' || lpad(CAST(month(hour) - 1 AS VARCHAR), 2, '0')
         || '/' || strftime(hour, '%d') || '/' || strftime(hour, '%H') || 'h_ticks.bi5' AS path
  FROM archived GROUP BY 1, 2),
spans AS (
  SELECT instrument, min(hour)::DATE AS first_day, max(hour)::DATE AS last_day FROM archived GROUP BY 1),
manifest AS (
  SELECT instrument, unnest(generate_series(first_day::TIMESTAMP, last_day::TIMESTAMP + INTERVAL 23 HOUR,
         INTERVAL 1 HOUR)) AS hour FROM spans),
files AS (
  SELECT m.instrument, m.hour,
         upper(m.instrument) || '/' || strftime(m.hour, '%Y') || '/' ||
         lpad(CAST(month(m.hour) - 1 AS VARCHAR), 2, '0') || '/' || strftime(m.hour, '%d') || '/' ||
         strftime(m.hour, '%H') || 'h_ticks.bi5' AS path,
         CASE WHEN p.n IS NULL THEN 'no_data'
              WHEN hour_of_day = {_HOUR_OF["empty"]} THEN 'empty'
              WHEN hour_of_day IN ({_DAMAGED}) THEN 'error' ELSE 'ok' END AS status,
         CASE WHEN p.n IS NULL OR hour_of_day IN ({_DAMAGED}) THEN 0 ELSE p.n END AS n_ticks
  FROM manifest m LEFT JOIN path_of p ON p.instrument = m.instrument AND p.hour = m.hour)"""
_TOTALS = """count(*) AS hours, count(*) FILTER (status = 'ok') AS ok_hours,
       count(*) FILTER (status = 'empty') AS empty_hours, count(*) FILTER (status = 'no_data') AS no_data_hours,
       count(*) FILTER (status = 'error') AS skipped_hours, CAST(sum(n_ticks) AS BIGINT) AS ticks"""
_TASKS = f"""{_FILES},
tasks AS (SELECT instrument, count(*) FILTER (status <> 'no_data') AS done, count(*) AS total FROM files GROUP BY 1)"""
_PROGRESS = """CAST(sum(done) AS BIGINT) AS hours_completed, CAST(sum(total) AS BIGINT) AS hours_total,
       CAST(sum(done) AS DOUBLE) / CAST(sum(total) AS DOUBLE) * 100 AS progress_percent"""

# Parts as instruments.

_CATEGORY = (
    "CASE WHEN p_size % 10 = 9 THEN 'etf' WHEN p_size % 10 = 8 THEN 'other' "
    + " ".join(f"WHEN p_type = '{t}' THEN '{c}'" for t, c in fr.PART_CATEGORIES.items())
    + " ELSE p_type END"
)
PARTS = f"""WITH {STATS_CTE}, parts AS (
  SELECT p_partkey, 'key' || p_partkey AS lookup_key, 'part' || p_partkey AS id,
         p_name AS name, p_brand || ' ' || p_type AS description, {_CATEGORY} AS category,
         CAST(10 ** (p_size % 6) AS BIGINT) AS decimal_factor,
         CASE WHEN p_size % 8 <> 0
              THEN CAST(DATE '1995-01-01' + CAST(p_partkey * 7 % 2400 AS INTEGER) AS TIMESTAMP) END AS start_tick_date
  FROM part)"""
_PART_COLUMNS = "lookup_key, id, name, description, category, decimal_factor, start_tick_date"


def _found(pattern: str) -> str:
    return f"(contains(lower(id), '{pattern.lower()}') OR contains(lower(name), '{pattern.lower()}'))"



def _date(day) -> str:
    return f"DATE '{day.isoformat()}'"


def _ranges(start: str, end: str, where: str = "true") -> str:
    return f"""{PARTS} SELECT instrument, start_date, end_date, CAST(end_date - start_date AS BIGINT) + 1 AS days_total,
       (CAST(end_date - start_date AS BIGINT) + 1) * 24 AS hours_total
FROM (SELECT id AS instrument, {start} AS start_date, {end} AS end_date FROM parts) WHERE {where}"""


def _estimates(source: str, columns: str, mbps: float = 10.0) -> str:
    """Estimates of rows that have category and hours."""
    b, t = DEFAULT_STATS["avg_compressed_bytes_per_hour"], DEFAULT_STATS["avg_ticks_per_hour"]
    return f"""SELECT {columns}, hours AS total_hours, b AS compressed_bytes,
       CAST(b * {COMPRESSION_RATIO}::DOUBLE AS BIGINT) AS uncompressed_bytes,
       CAST(b * {COMPRESSION_RATIO}::DOUBLE AS BIGINT) AS output_bytes, t AS ticks,
       CAST(b AS DOUBLE) / ({mbps}::DOUBLE * 1000000 / 8) AS duration_seconds,
       CASE WHEN known THEN 'high' ELSE 'low' END AS confidence
FROM (SELECT r.*, coalesce(s.bytes, {b}) * hours AS b, coalesce(s.ticks, {t}) * hours AS t, s.bytes IS NOT NULL AS known
      FROM {source} r LEFT JOIN stats s ON s.category = r.category)"""


def _estimate_sql() -> str:
    columns = "l_orderkey, l_linenumber, instrument, start_date, end_date, r_category AS category"
    return f"""{PARTS}, ranges AS (
  SELECT l_orderkey, l_linenumber, id AS instrument, category, category AS r_category,
         l_shipdate::DATE AS start_date, l_shipdate::DATE + CAST(l_quantity AS INTEGER) AS end_date,
         (CAST(l_quantity AS BIGINT) + 1) * 24 AS hours
  FROM lineitem JOIN parts ON p_partkey = l_partkey)
{_estimates("ranges", columns)}"""


def _batch_sql() -> str:
    hours = ((q.BATCH_RANGE[1] - q.BATCH_RANGE[0]).days + 1) * 24
    b, t = DEFAULT_STATS["avg_compressed_bytes_per_hour"], DEFAULT_STATS["avg_ticks_per_hour"]
    return f"""{PARTS}, s AS (
  SELECT count(*) * {hours} AS h, CAST(sum(coalesce(bytes, {b})) * {hours} AS BIGINT) AS b,
         CAST(sum(coalesce(ticks, {t})) * {hours} AS BIGINT) AS t, bool_and(bytes IS NOT NULL) AS known
  FROM parts LEFT JOIN stats USING (category))
SELECT h AS total_hours, b AS compressed_bytes, b * 10 AS uncompressed_bytes, b * 10 AS output_bytes, t AS ticks,
       CAST(b AS DOUBLE) / (25.0::DOUBLE * 1000000 / 8) AS duration_seconds,
       CASE WHEN known THEN 'high' ELSE 'low' END AS confidence FROM s"""


def _lookback_sql() -> str:
    as_of = _date(q.AS_OF)
    parts = [
        f"SELECT id AS instrument, category, '{name}' AS period, {as_of} - {days} AS start_date FROM parts "
        "WHERE start_tick_date IS NOT NULL"
        for name, days in LOOKBACKS.items()
    ]
    parts.append(
        f"SELECT id, category, '{FULL_HISTORY}', start_tick_date::DATE FROM parts "
        f"WHERE start_tick_date::DATE <= {as_of}"
    )
    union = " UNION ALL ".join(parts)
    return f"""{PARTS}, ranges AS (
  SELECT instrument, category AS r_category, category, period, start_date, {as_of} AS end_date,
         CAST({as_of} - start_date AS DOUBLE) / 365.25 AS years,
         (CAST({as_of} - start_date AS BIGINT) + 1) * 24 AS hours
  FROM ({union}))
{_estimates("ranges", "instrument, r_category AS category, period, start_date, end_date, years")}"""


def _alias_sql() -> str:
    parts = [
        f"SELECT '{tf}' AS timeframe, {BAR_SECONDS[tf]} AS seconds, instrument, ms // {BAR_SECONDS[tf] * 1000} AS bar "
        "FROM ticks"
        for tf in ALIAS_TIMEFRAMES
    ]
    return f"""{TICKS}, per_bar AS (
  SELECT timeframe, seconds, instrument, bar, count(*) AS n FROM ({" UNION ALL ".join(parts)}) GROUP BY ALL)
SELECT timeframe, CAST(seconds AS BIGINT) AS seconds, count(*) AS bars, CAST(sum(n) AS BIGINT) AS ticks,
       max(n) AS most_ticks FROM per_bar GROUP BY 1, 2"""


def _damaged_bars(instrument: str) -> str:
    return f"""WITH {_raw_cte(instrument)}, {_TICKS_CTE},
readable AS (SELECT * FROM ticks WHERE ms // 3600000 % 24 NOT IN ({_DAMAGED}))
{_bars(3600, "readable")}"""


def oracle_sql() -> dict[str, str]:
    start, end = _date(q.LATE_START), _date(q.LATE_END)
    epoch_path = """upper(instrument) || '/' || strftime(hour, '%Y') || '/' ||
       lpad(CAST(month(hour) - 1 AS VARCHAR), 2, '0') || '/' || strftime(hour, '%d') || '/' ||
       strftime(hour, '%H') || 'h_ticks.bi5'"""
    raw_hours = f"{RAW}, hours AS (SELECT *, make_timestamp(ms // 3600000 * 3600000000) AS hour FROM raw)"
    starts = ", ".join(f"make_timestamp(ms // {s * 1000} * {s * 1000000}) AS {tf}_start" for tf, s in BAR_SECONDS.items())
    bars15 = f"{TICKS} {_bars(900)}"

    def parts_where(condition: str) -> str:
        return f"{PARTS} SELECT {_PART_COLUMNS} FROM parts WHERE {condition}"

    return {
        "S1_archive_scan": f"{_SHARD_TICKS} {_ARCHIVED_ROWS}",
        "S1_list_archive": f"""{_FILES} SELECT instrument, hour, path,
hour_of_day = {_HOUR_OF["zero_length"]} AS zero_length FROM path_of""",
        "S1_selected_scan": f"""{_SHARD_TICKS} {_ARCHIVED_ROWS} WHERE instrument IN {q.SELECTED}
AND hour BETWEEN TIMESTAMP '{q.SELECTED_HOURS[0]}' AND TIMESTAMP '{q.SELECTED_HOURS[1]}'""",
        "S2_strict_scan": f"""{_SHARD_TICKS} SELECT instrument, hour, count(*) AS n_ticks,
CAST(sum(ask_raw) AS BIGINT) AS ask_sum, max(seq) AS last_seq FROM archived GROUP BY 1, 2""",
        "S3_resilient_scan": f"{_SHARD_TICKS} {_ARCHIVED_ROWS} WHERE hour_of_day NOT IN ({_DAMAGED})",
        "S3_file_status": f"{_FILES} SELECT instrument, hour, path, status, n_ticks FROM files",
        "S3_unreadable": f"""{_FILES}, seen AS (
  SELECT m.instrument, m.hour, m.path, p.n, p.hour_of_day = 8 AND m.instrument LIKE 'signup%' AS refused
  FROM files m LEFT JOIN path_of p USING (instrument, hour))
SELECT instrument, hour, path, CASE WHEN n IS NULL THEN 'no_data' WHEN refused THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN n IS NULL OR refused THEN 0 ELSE n END AS n_ticks
FROM seen""",
        "S4_explode_batches": f"""{raw_hours}, t AS (
  SELECT *, unnest(CASE WHEN event_type = 'error' THEN [] ELSE generate_series(0, k % 4 - 1) END) AS tick FROM hours)
SELECT instrument, hour, seq, tick, ms % 3600000 + tick AS ms_offset, ask_raw FROM t""",
        "S5_registry_join": f"""WITH {REGISTRY_CTE}, used AS (
  SELECT {_REGISTRY_INSTRUMENT} AS id, count(*) AS n_events FROM events GROUP BY 1)
SELECT r.*, n_events FROM used JOIN registry r USING (id)""",
        "S6_category_stats": f"""{PARTS} SELECT id, category,
coalesce(bytes, {DEFAULT_STATS["avg_compressed_bytes_per_hour"]}) AS avg_compressed_bytes_per_hour,
coalesce(ticks, {DEFAULT_STATS["avg_ticks_per_hour"]}) AS avg_ticks_per_hour, bytes IS NOT NULL AS known
FROM parts LEFT JOIN stats USING (category)""",
        "P1_normalize": f"{TICKS} {TICK_ROWS}",
        "P1_normalize_registry": f"{REGISTRY_TICKS} {TICK_ROWS}",
        "P1_overflow_order": f"""{TICKS}, moved AS (SELECT *, ms - ms % 60000 AS minute FROM ticks)
SELECT instrument, make_timestamp(minute // 86400000 * 86400000000) AS timestamp,
       first(mid ORDER BY minute, seq % 3 DESC, seq) AS open, max(mid) AS high, min(mid) AS low,
       last(mid ORDER BY minute, seq % 3 DESC, seq) AS close, sum(vol) AS volume, count(*) AS tick_count
FROM moved GROUP BY 1, 2""",
        "P2_mid": f"{TICKS} SELECT seq, mid FROM ticks",
        "P3_spread": f"{TICKS} SELECT seq, ask - bid AS spread FROM ticks",
        "P4_total_volume": f"{TICKS} SELECT seq, vol AS total_volume FROM ticks",
        "P5_range": _metric("range", "high - low"),
        "P6_body": _metric("body", "abs(close - open)"),
        "P7_is_bullish": _metric("is_bullish", "close > open"),
        "P8_is_bearish": _metric("is_bearish", "close < open"),
        "P9_typical_price": _metric("typical_price", "(high + low + close) / 3"),
        "P10_weighted_close": _metric("weighted_close", "(high + low + 2 * close) / 4"),
        "P11_archive_path": f"{raw_hours} SELECT seq, {epoch_path} AS path FROM hours",
        "P12_hour_from_path": f"""{raw_hours} SELECT seq,
CASE WHEN k % 7 IN (0, 1, 2, 4) THEN NULL ELSE hour END AS hour FROM hours""",
        "P13_ticks_in_payload": "SELECT doc_id, n_chars // 20 AS n_ticks FROM documents",
        "F1_get_instrument": parts_where(f"lookup_key = '{q.LOOKUP_KEY.lower()}'"),
        "F2_by_category": parts_where("category = 'etf'"),
        "F2_forex": parts_where("category = 'forex'"),
        "F2_crypto": parts_where("category = 'crypto'"),
        "F2_indices": parts_where("category = 'index'"),
        "F2_stocks": parts_where("category = 'stock'"),
        "F2_commodities": parts_where("category = 'commodity'"),
        "F3_search_name": parts_where(_found(q.SEARCH_NAME)),
        "F3_search_id": parts_where(_found(q.SEARCH_ID)),
        "F4_list_category": parts_where("category = 'bond'"),
        "F4_list_pattern": parts_where(_found(q.SEARCH_NAME)),
        "F4_list_all": parts_where("true"),
        "F5_has_data_for": f"""{PARTS} SELECT id AS instrument,
count(*) FILTER (coalesce(l_shipdate >= start_tick_date, false)) AS with_data,
count(*) FILTER (NOT coalesce(l_shipdate >= start_tick_date, false)) AS without_data
FROM lineitem JOIN parts ON p_partkey = l_partkey GROUP BY 1""",
        "F6_in_range": f"""SELECT event_id, ts FROM events
WHERE ts::DATE BETWEEN {_date(q.IN_RANGE[0])} AND {_date(q.IN_RANGE[1])}""",
        "T1_timeframe_aliases": _alias_sql(),
        "T2_bar_start": f"{TICKS} SELECT seq, timestamp AS tick_start, {starts} FROM ticks",
        "T3_hour_spine": """WITH h AS (
  SELECT 'cust' || o_custkey AS instrument,
         unnest(generate_series(o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) + INTERVAL 23 HOUR,
                                INTERVAL 1 HOUR)) AS hour FROM orders)
SELECT instrument, count(*) AS hours, min(hour) AS first_hour, max(hour) AS last_hour,
       CAST(sum(epoch_us(hour) // 3600000000) AS BIGINT) AS hour_sum FROM h GROUP BY 1""",
        "T4_range_totals": f"""{PARTS} SELECT id AS instrument, CAST(sum(CAST(l_quantity AS BIGINT) + 1) AS BIGINT) AS days,
CAST(sum((CAST(l_quantity AS BIGINT) + 1) * 24) AS BIGINT) AS hours
FROM lineitem JOIN parts ON p_partkey = l_partkey GROUP BY 1""",
        **{f"A1_ohlcv_{tf}": f"{TICKS} {_bars(s)}" for tf, s in BAR_SECONDS.items()},
        "A1_ohlcv_wide_seq": f"{TICKS} {_bars(86400)}",
        "A1_cascade": TICKS + " UNION ALL ".join(f" SELECT *, '{tf}' AS timeframe FROM ({_bars(n)})" for tf, n in BAR_SECONDS.items()),
        "A2_registry_bars_h1": f"{REGISTRY_TICKS} {_bars(3600)}",
        "A3_tick_bars": f"""{TICKS} SELECT instrument, timestamp, first(mid ORDER BY seq) AS open, max(mid) AS high,
min(mid) AS low, last(mid ORDER BY seq) AS close, sum(vol) AS volume, count(*) AS tick_count FROM ticks GROUP BY 1, 2""",
        "A4_run_totals": f"{_FILES} SELECT {_TOTALS} FROM files",
        "A4_observed_totals": f"{_FILES} SELECT {_TOTALS} FROM files",
        "R1_stream_bars": f"""{TICKS}, bars AS ({_bars(3600)})
SELECT * FROM bars WHERE timestamp + INTERVAL 1 HOUR <= (SELECT max(timestamp) FROM ticks) - INTERVAL 1 HOUR""",
        "R2_stream_archive": f"{_SHARD_TICKS} {_ARCHIVED_ROWS}",
        "R2_stream_file_status": f"""{_FILES} SELECT instrument, hour, path, status, n_ticks FROM files
WHERE status <> 'no_data'""",
        "R2_stream_reader_status": f"""{_FILES} SELECT instrument, hour, path, status, n_ticks FROM files
WHERE status <> 'no_data'""",
        "R2_stream_archive_bars": _damaged_bars("event_type"),
        "R1_stateful_bars": f"""{TICKS}, bars AS ({_bars(3600)})
SELECT * FROM bars b WHERE timestamp < (SELECT max(timestamp) FROM bars o WHERE o.instrument = b.instrument)""",
        "R3_stream_flush": f"{TICKS} {_bars(3600)}",
        "R3_compacted": f"{TICKS} {_bars(3600)}",
        "C1_manifest": f"""{PARTS}, wanted AS (
  SELECT id AS instrument, greatest({_date(q.MANIFEST_START)}, start_tick_date::DATE) AS first_day FROM parts),
hours AS (
  SELECT instrument, unnest(generate_series(first_day::TIMESTAMP, {_date(q.MANIFEST_END)}::TIMESTAMP + INTERVAL 23 HOUR,
         INTERVAL 1 HOUR)) AS hour FROM wanted WHERE first_day <= {_date(q.MANIFEST_END)})
SELECT instrument, hour, {epoch_path} AS path FROM hours""",
        "C1_requests_default_start": _ranges(
            "greatest((SELECT min(start_tick_date)::DATE FROM parts), start_tick_date::DATE)",
            end,
            "start_date <= end_date",
        ),
        "C1_requests_clipped": _ranges(f"greatest({start}, start_tick_date::DATE)", end, "start_date <= end_date"),
        "C1b_requests_unclipped": _ranges(start, end),
        "C1b_requests_own_start": _ranges("coalesce(start_tick_date::DATE, DATE '2003-05-05')", "DATE '2003-12-31'"),
        "C2_coverage": f"{_FILES} SELECT instrument, hour, path, status, n_ticks FROM files",
        "C2_coverage_by_instrument": f"{_FILES} SELECT instrument, {_TOTALS} FROM files GROUP BY 1",
        "C3_pending": f"""{_FILES} SELECT instrument, hour, path FROM files
WHERE status NOT IN ('ok', 'empty') AND dayofweek(hour) <> 0""",
        "C3_pending_ranges": f"""{_FILES} SELECT instrument, hour, path FROM files
WHERE status NOT IN ('ok', 'empty') AND dayofweek(hour) <> 0""",
        "C3_hour_ranges": """WITH hours AS (
  SELECT DISTINCT 'g' || (user_id % 50) AS instrument, epoch_us(ts) // 3600000000 AS at_hour FROM events),
islands AS (SELECT *, at_hour - row_number() OVER (PARTITION BY instrument ORDER BY at_hour) AS island FROM hours)
SELECT instrument, make_timestamp(min(at_hour) * 3600000000) AS first_hour, make_timestamp(max(at_hour) * 3600000000) AS last_hour
FROM islands GROUP BY instrument, island""",
        "C4_progress": f"{_TASKS} SELECT instrument, {_PROGRESS} FROM tasks GROUP BY ROLLUP (instrument)",
        "C4_overall_progress": f"{_TASKS} SELECT {_PROGRESS} FROM tasks",
        "C5_instrument_ids": f"{PARTS} SELECT lookup_key FROM parts",
        "C5_instrument_count": f"{PARTS} SELECT count(*) AS n_instruments FROM parts",
        "E1_estimate": _estimate_sql(),
        "E2_estimate_batch": _batch_sql(),
        "E3_peak_stats": f"""{PARTS} SELECT category, count(*) AS n,
count(*) * CAST(coalesce(any_value(bytes * peak), {DEFAULT_STATS["avg_compressed_bytes_per_hour"] * DEFAULT_STATS["peak_multiplier"]}) AS BIGINT) AS peak_bytes,
count(*) * CAST(coalesce(any_value(ticks * peak), {DEFAULT_STATS["avg_ticks_per_hour"] * DEFAULT_STATS["peak_multiplier"]}) AS BIGINT) AS peak_ticks
FROM parts LEFT JOIN stats USING (category) GROUP BY 1""",
        "E4_estimate_lookbacks": _lookback_sql(),
        "K1_csv_ticks": f"{TICKS} {WRITTEN_TICKS}",
        "K2_csv_bars": bars15,
        "K3_tsv_no_header": f"{TICKS} {WRITTEN_TICKS}",
        "K4_ndjson_ticks": f"{TICKS} {WRITTEN_TICKS}",
        "K4_ndjson_bars": bars15,
        "K5_json_ticks": f"{TICKS} {WRITTEN_TICKS}",
        "K5_json_bars_pretty": bars15,
        "K5_documents": f"{TICKS} {WRITTEN_TICKS}",
        "K6_parquet_ticks": f"{TICKS} {WRITTEN_TICKS}",
        "K6_parquet_bars": bars15,
        "K1_csv_lines": _csv_lines(",", True),
        "K3_tsv_lines": _csv_lines("\\t", False),
        "K7_file_ranges": f"""{TICKS} SELECT instrument, min(timestamp) AS first, max(timestamp) AS last, count(*) AS ticks,
0 AS overlaps FROM ticks GROUP BY 1""",
        "K8_format_names": """SELECT CASE WHEN event_id % 11 < 2 THEN 'csv' WHEN event_id % 11 < 4 THEN 'json' WHEN event_id % 11 < 6 THEN 'ndjson'
WHEN event_id % 11 < 9 THEN 'parquet' END AS format, count(*) AS n FROM events GROUP BY 1""",
        "K7_ordered_parquet_ticks": f"{TICKS} {WRITTEN_TICKS}",
        "A2_download_all_h1": _damaged_bars(_SHARD),
        # The first run read the files that hold no tick, so the second does not open them again.
        "C3_concurrent_runs": f"""WITH {_raw_cte(_SHARD)}, {_TICKS_CTE},
finished AS (SELECT * FROM ticks WHERE ms // 3600000 % 24 <> {_HOUR_OF["empty"]})
{_bars(3600, "finished")}""",
        "C3_resumed_run": f"""WITH {_raw_cte(_SHARD)}, {_TICKS_CTE},
finished AS (SELECT * FROM ticks WHERE ms // 3600000 % 24 <> {_HOUR_OF["empty"]})
{_bars(3600, "finished")}""",
    }
