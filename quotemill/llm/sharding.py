"""Shards of nearly equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the id, hash of the row's place in its file). Key boundaries that cut the
order into equal shares of bytes are found by counting: tasks add up the exact bytes and rows below each probed boundary, and
every boundary that is not yet within tolerance is probed again between the two closest ones. Only then the rows move,
once, into ranges that a task can hold; a row's slot is its place in its range plus the counted rows before that range.

Probes go down to single text hashes before they look inside one, so documents with equal texts stay in one shard, unless
their group alone outweighs the tolerance; then it is cut by ids, and a row repeated as often by its place in the input.

A shard's bytes differ from an equal share by ``TOLERANCE`` of it at each end, or by the heaviest single row where that is more.

Odd input: a null text has no bytes, like an empty one; null ids are a key like any other. Fewer rows than shards leave
shards empty; an empty table gives no rows. The document travels as one struct, so its columns cannot clash with the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

SHARDS = 24
TOLERANCE = 0.01  # of a shard's bytes, at each of its boundaries
ROW_BYTES = 8  # that a row counts beside its text
RANGE_BYTES = 512 << 20  # of a shard that one task numbers; the driver holds a few boundaries for each
PROBES = 8  # between two counted boundaries

WORD = 1 << 64
KEYS = WORD**3  # three hashes of 64 bits, the first one the highest
KEY = ("key1", "key2", "key3")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + ROW_BYTES


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents as structs with their sizes and keys; read twice, they give the same."""
    try:
        place = docs.metadataColumn("_metadata")
        own = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("row"), place["file_path"].alias("file"), place["row_index"].alias("at"))
        own.schema  # raises where the rows do not come straight from files
    except Exception as error:  # noqa: BLE001
        raise ValueError("shards need rows read from a table, so that a row keeps its place") from error
    return own.select(
        "row",
        text_bytes(F.col(f"row.`{text}`")).alias("size"),
        F.xxhash64(f"row.`{text}`").alias("key1"),
        F.xxhash64(f"row.`{key}`").alias("key2"),
        F.xxhash64("file", "at").alias("key3"),
    )


def as_bytes(boundaries: list[int]) -> np.ndarray:
    """Whole keys as strings of 24 bytes that compare like the numbers."""
    return np.array([value.to_bytes(24, "big") for value in boundaries], "S24")


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    """The keys of a batch in the same form; signed hashes in their own order."""
    words = np.stack([batch.column(name).to_numpy() for name in KEY], axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return np.ascontiguousarray(words.astype(">u8")).view("S24").ravel()


def counted(keys: DataFrame, boundaries: list[int]) -> tuple[np.ndarray, np.ndarray, list]:
    """Exact bytes and rows below each boundary, ascending, and over all; and the first and last key of each cell between them."""
    probes = as_bytes(boundaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        ends: dict[int, tuple[bytes, bytes]] = {}
        for batch in batches:
            own = _keys(batch)
            order = np.argsort(own)
            own = own[order]
            cell = np.searchsorted(probes, own, "right")
            np.add.at(size, cell, batch.column("size").to_numpy()[order])
            np.add.at(rows, cell, 1)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
            for start, stop in zip(starts, np.r_[starts[1:], len(cell)], strict=False):
                low, high = (bytes(own[at]).ljust(24, b"\0") for at in (start, stop - 1))
                at = int(cell[start])
                ends[at] = (min(low, ends[at][0]), max(high, ends[at][1])) if at in ends else (low, high)
        met = sorted(ends)
        made = [pa.array(met, pa.int32()), pa.array(size[met]), pa.array(rows[met])]
        made += [pa.array([ends[at][side] for at in met], pa.binary()) for side in (0, 1)]
        yield pa.RecordBatch.from_arrays(made, ["cell", "size", "n", "low", "high"])

    cells = keys.mapInArrow(run, "cell int, size bigint, n bigint, low binary, high binary").groupBy("cell")
    cells = cells.agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found, ends = np.zeros((2, len(probes) + 1), np.int64), [(0, 0)] * (len(probes) + 1)
    for row in cells.collect():
        found[:, row.cell] = row.size, row.n
        ends[row.cell] = (int.from_bytes(row.low, "big"), int.from_bytes(row.high, "big"))
    size, rows = found.cumsum(axis=1)
    return size, rows, ends


def _between(first: int, last: int, probes: int) -> list[int]:
    """Boundaries that part the keys from the first to the last one: between texts, or inside a text that is alone."""
    text = WORD**2
    step = 1 if first // text == last // text else text
    made = {first + (last - first) * i // (probes + 1) for i in range(1, probes + 1)} | {last}
    return sorted(value for value in {value // step * step for value in made} if first < value <= last)


def splitters(
    keys: DataFrame, shards: int, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES, probes: int = PROBES
) -> tuple[list[int], int, list[int]]:
    """Boundaries of ranges, the number of ranges in each shard, and the rows below every boundary.

    The boundaries of shards are refined until the bytes below them are within tolerance, those of ranges inside a shard
    until they are within a quarter of a range.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    each = max(4, -(-total // (shards * range_bytes)))
    goals = [total * i // (shards * each) for i in range(1, shards * each)]
    slack = [total / shards * (tolerance if i % each == 0 else 0.25 / each) for i in range(1, shards * each)]
    chosen = [(0, 0)] * len(goals)  # boundary, rows below it
    left = set(range(len(goals))) if total else set()
    new = _between(0, KEYS - 1, probes * shards * each)
    while left:
        size, rows, ends = counted(keys, new)
        edges, below, rows_below = [0, *new, KEYS], np.r_[0, size], np.r_[0, rows]
        new = set()
        for goal in sorted(left):
            at = int(np.searchsorted(below, goals[goal], "right")) - 1  # the cell that the goal lies in
            best = min((at, at + 1), key=lambda edge: abs(below[edge] - goals[goal]))
            inside = _between(*ends[at], probes)
            if abs(below[best] - goals[goal]) <= slack[goal] or not inside:
                chosen[goal] = edges[best], int(rows_below[best])
                left.remove(goal)
            else:
                new.update(inside, edges[at : at + 2])
        new = sorted(new - {0, KEYS})
    return [value for value, _ in chosen], each, [n for _, n in chosen]


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    key: str = "doc_id",
    text: str = "text",
    tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """All documents, as structs ``row``, with ``shard`` and ``slot``: the place in the shard, without gaps."""
    if shards < 1:
        raise ValueError("there is at least one shard")
    rows = keyed(docs, key, text)
    boundaries, each, below = splitters(settled(rows.select("size", *KEY), "shard-keys"), shards, tolerance, range_bytes)
    cuts = as_bytes([min(value, KEYS - 1) for value in boundaries])
    before = np.array([0, *below], np.int64)  # rows before each range
    kept = [*KEY, "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.searchsorted(cuts, _keys(batch), "right").astype(np.int32)
            shard = place // np.int32(each)
            made = [pa.array(place), pa.array(shard), pa.array(before[place] - before[shard * each])]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in kept] + made, [*kept, "range", "shard", "base"])

    kinds = dict(rows.dtypes)
    placed = rows.select(*kept).mapInArrow(run, ", ".join(f"{name} {kinds[name]}" for name in kept) + ", range int, shard int, base bigint")
    return placed.withColumn("nth", F.expr(f"row_number() OVER (PARTITION BY range ORDER BY {', '.join(KEY)})")).select(
        "row", "shard", (F.col("base") + F.col("nth") - 1).alias("slot")
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return assign(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"),
        text_bytes(text).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
