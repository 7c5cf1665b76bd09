"""CSV, JSON, NDJSON and Parquet output of ticks and bars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BARS, TICKS
from ..session import configure, setting

# Output formats and their accepted names.
FORMATS = {"csv": ("csv",), "json": ("json",), "ndjson": ("ndjson", "jsonl"), "parquet": ("parquet", "pq")}

# Fixed value: rows of a Parquet row group, unless given.
ROW_GROUP_ROWS = 100_000

# Timestamp texts. CSV bars have no fraction; JSON shows one only where there is one.
SECONDS_TEXT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
MILLIS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

TICK_FIELDS = [f for f in TICKS.fields if f.name not in ("instrument", "seq")]
BAR_FIELDS = [f for f in BARS.fields if f.name != "instrument"]
NUMBER_TYPES = ("double", "float")


def parse_format(name: str) -> str:
    """Canonical format name, in any case."""
    for canonical, names in FORMATS.items():
        if name.lower() in names:
            return canonical
    raise ValueError(f"unknown format {name!r}, expected one of: {', '.join(FORMATS)}")


def format_name(name: Column | str) -> Column:
    """``parse_format`` of a column; NULL where the name is unknown."""
    given = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.coalesce(*[F.when(given.isin(*names), canonical) for canonical, names in FORMATS.items()])


def plain_number(number: Column | str) -> Column:
    """A double or float as text without exponent and without a zero fraction: ``100``, ``0.00001``."""
    return _plain((F.col(number) if isinstance(number, str) else number).cast("string"))


def _plain(text: Column) -> Column:
    """``plain_number`` from the text Spark gives a number.

    Only a text with an exponent is printed anew, with more decimals than a double can have; the printer pads
    with zeros, which are cut off again.
    """
    printed = F.format_string("%.340f", text.cast("double"))
    return (
        F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2))
        .when(F.contains(text, F.lit("E")), F.rtrim(F.rtrim(printed, F.lit("0")), F.lit(".")))
        .when(text == "Infinity", F.lit("inf"))
        .when(text == "-Infinity", F.lit("-inf"))
        .otherwise(text)
    )


def _csv_rows(rows: DataFrame, key: list[str], fields, time_text: str) -> DataFrame:
    """All fields as CSV text. Numbers become text in a step of their own, so that each is printed only once."""

    def numeric(field) -> bool:
        return field.dataType.simpleString() in NUMBER_TYPES

    def first(field) -> Column:
        if field.name == "timestamp":
            return F.date_format("timestamp", time_text).alias("timestamp")
        return F.col(field.name).cast("string").alias(field.name) if numeric(field) else F.col(field.name)

    texts = rows.select(*key, *[first(f) for f in fields])
    return texts.select(*key, *[_plain(F.col(f.name)).alias(f.name) if numeric(f) else F.col(f.name) for f in fields])


def _json_columns(fields) -> list[Column]:
    """Values as JSON shows them: a number that is not finite becomes null."""

    def value(field) -> Column:
        column = F.col(field.name)
        if field.name == "timestamp":
            whole = F.unix_millis(column) % 1000 == 0
            shown = F.when(whole, F.date_format(column, SECONDS_TEXT)).otherwise(F.date_format(column, MILLIS_TEXT))
        elif field.dataType.simpleString() in NUMBER_TYPES:
            shown = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
        else:
            shown = column
        return shown.alias(field.name)

    return [value(f) for f in fields]


def json_text(fields, pretty: bool) -> Column:
    """A row as a JSON object; ``pretty`` indents it as an element of an array."""
    text = F.to_json(F.struct(*_json_columns(fields)), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    return F.concat(F.lit("  "), F.replace(text, F.lit("\n"), F.lit("\n  "))) if pretty else text


def _frame_arrays(by_instrument: bool):
    """Turn each partition's JSON rows into array documents, one per instrument or one in all, row by row."""

    def rows(instrument: str, first: int, texts: pa.Array) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict(
            {
                "instrument": pa.repeat(instrument, n),
                "line": pa.array(range(first, first + n), type=pa.int64()),
                "value": texts,
            }
        )

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, line = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch["instrument"])
            start = 0
            for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                texts = batch["value"].slice(start, end - start)
                start = end
                head = []
                if name != current:
                    if current is not None:
                        yield rows(current, line, pa.array([last, "]"]))
                    current, line = name, 0
                    head = ["["]
                else:
                    head = [last + ","]
                last = texts[-1].as_py()
                body = pc.binary_join_element_wise(texts.slice(0, len(texts) - 1), ",", "")
                out = pa.concat_arrays([pa.array(head, type=pa.string()), body.cast(pa.string())])
                yield rows(current, line, out)
                line += len(out)
        if current is not None:
            yield rows(current, line, pa.array([last, "]"]))
        elif not by_instrument:
            yield rows("", 0, pa.array(["[", "]"]))

    return frame


def _laid_out(df: DataFrame, order: list[str], by_instrument: bool, ordered: bool) -> DataFrame:
    """Put rows in file order.

    Per instrument, rows are dealt by sampled ranges of (instrument, time): small instruments share a task, a hot one is
    split, and each of its files has a stretch of time of its own. Without instrument folders rows stay in their tasks,
    sorted there. ``ordered`` sorts the whole output.
    """
    keys = ["instrument", *order] if by_instrument else order
    if ordered:
        return df.orderBy(*keys)
    if by_instrument:
        df = df.repartitionByRange(*keys)
    return df.sortWithinPartitions(*keys)


def _write(
    df: DataFrame,
    fields,
    order: list[str],
    csv_time: str,
    path: str,
    format: str,
    delimiter: str,
    header: bool,
    pretty: bool,
    compression: str | None,
    row_group_rows: int | None,
    partition_by_instrument: bool,
    ordered: bool,
    mode: str,
) -> None:
    fmt = parse_format(format)
    configure(df.sparkSession)
    key = ["instrument"] if partition_by_instrument else []
    rows = _laid_out(df, order, partition_by_instrument, ordered)

    if fmt == "csv":
        out = _csv_rows(rows, key, fields, csv_time)
    elif fmt == "parquet":
        out = rows.select(*key, *[F.col(f.name).cast(f.dataType) for f in fields])
    elif fmt == "ndjson":
        out = rows.select(*key, *_json_columns(fields))
    else:
        text = json_text(fields, pretty)
        name = F.col("instrument") if key else F.lit("").alias("instrument")
        framed = rows.select(name, text.alias("value")).mapInArrow(
            _frame_arrays(partition_by_instrument), "instrument string, line bigint, value string"
        )
        if key:
            framed = framed.sortWithinPartitions("instrument", "line")
        out = framed.select(*key, "value")

    writer = out.write.mode(mode)
    if key:
        writer = writer.partitionBy("instrument")
    if compression:
        writer = writer.option("compression", compression)
    # Tasks that follow each other are merged up to the advisory size, whatever the number of cores.
    merge = "spark.sql.adaptive.coalescePartitions"
    with setting(df.sparkSession, f"{merge}.parallelismFirst", "false"), setting(df.sparkSession, f"{merge}.minPartitionSize", "1"):
        if fmt == "csv":
            writer.option("sep", delimiter).option("header", header).csv(path)
        elif fmt == "parquet":
            if row_group_rows:
                writer = writer.option("parquet.block.row.count.limit", row_group_rows)
            writer.parquet(path)
        elif fmt == "ndjson":
            writer.option("ignoreNullFields", "false").json(path)
        else:
            writer.text(path)


def write_ticks(
    ticks: DataFrame,
    path: str,
    format: str = "csv",
    *,
    delimiter: str = ",",
    header: bool = True,
    pretty: bool = False,
    compression: str | None = None,
    row_group_rows: int | None = ROW_GROUP_ROWS,
    partition_by_instrument: bool = True,
    ordered: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write ``timestamp, ask, bid, ask_volume, bid_volume``.

    The files hold these columns only: with ``partition_by_instrument`` the instrument is in the folder name,
    without it the frame should hold one instrument. JSON files are one array document each (per instrument),
    as many files as there are partitions; ``pretty`` applies to them only. Delimiter and header are for CSV,
    row group size for Parquet, whose codec is snappy unless given.
    """
    _write(
        ticks,
        TICK_FIELDS,
        ["timestamp", "seq"],
        MILLIS_TEXT,
        path,
        format,
        delimiter,
        header,
        pretty,
        compression,
        row_group_rows,
        partition_by_instrument,
        ordered,
        mode,
    )


def write_bars(
    bars: DataFrame,
    path: str,
    format: str = "csv",
    *,
    delimiter: str = ",",
    header: bool = True,
    pretty: bool = False,
    compression: str | None = None,
    row_group_rows: int | None = ROW_GROUP_ROWS,
    partition_by_instrument: bool = True,
    ordered: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write ``timestamp, open, high, low, close, volume, tick_count``; options as for ``write_ticks``."""
    _write(
        bars,
        BAR_FIELDS,
        ["timestamp"],
        SECONDS_TEXT,
        path,
        format,
        delimiter,
        header,
        pretty,
        compression,
        row_group_rows,
        partition_by_instrument,
        ordered,
        mode,
    )
