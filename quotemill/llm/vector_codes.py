"""Vectors as short codes: of each part of a vector, the index of the nearest entry in that part's codebook.

Components count as integers, ``floor(scale * x)``, so sums and distances are exact and codebooks do not depend on the order
of the rows. The nearest entry is found by slices that are intersected (``Slices``): per dimension the sorted coordinates
of the entries select those within a radius, as a bitmask that is the difference of two prefix masks, and the masks of all
dimensions are ANDed. The radius starts small, doubles while nothing is found, and ends as the distance of the best
entry found, so that no nearer entry, and none as near, can lie outside the masks.

Codebooks are learnt in Spark: tasks add up the parts by nearest entry, and what reaches the driver is one row per entry,
whatever the number of vectors.

Odd input: a vector that is null or holds null, NaN or infinite components is left out. The size of vectors is that of the
smallest vec_id's vector; vectors of another size, and all of them where that size has no equal parts, keep their row with
null code and error, and take no part in codebooks or sums. Of rows that repeat a vec_id, the smallest vector by
components can found an entry; null vec_ids found none. All rows are coded. Fewer than 256 ids give fewer entries. Integers
are held within the range where a distance fits 64 bits (about 1.9e8 for 64 components, that is x of 185,000). An empty table
gives an empty one. Columns that are not asked for are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, table

PARTS = 4
ENTRIES = 256  # two hex digits
ROUNDS = 4
SCALE = 1024
PAIR_VALUES = 1 << 21  # coordinates of candidate pairs that are compared at a time


class Slices:
    """The exact nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, size = entries.shape
        order = np.argsort(entries, axis=0, kind="stable").T
        self.coordinates = np.sort(entries, axis=0).T.copy()
        self.prefix = np.zeros((size, count + 1, -(-count // 64)), np.uint64)
        for dimension in range(size):
            own = np.zeros((count, self.prefix.shape[2]), np.uint64)
            own[np.arange(count), order[dimension] >> 6] = np.uint64(1) << (order[dimension] & 63).astype(np.uint64)
            self.prefix[dimension, 1:] = np.bitwise_or.accumulate(own, axis=0)
        self.radius = self._usual_gap()

    def _usual_gap(self) -> int:
        """The median over entries of the widest coordinate difference to the entry closest by it."""
        gaps = np.array([np.abs(self.entries - entry).max(axis=1, initial=0) for entry in self.entries])
        np.fill_diagonal(gaps, np.iinfo(np.int64).max)
        return max(1, int(np.median(gaps.min(axis=1)))) if len(gaps) > 1 else 1

    def within(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries that are within the radius in every dimension."""
        kept = np.full((len(parts), self.prefix.shape[2]), ~np.uint64(0))
        for coordinates, prefix, values in zip(self.coordinates, self.prefix, parts.T, strict=True):
            first = np.searchsorted(coordinates, values - radius, "left")
            after = np.searchsorted(coordinates, values + radius, "right")
            kept &= prefix[after] ^ prefix[first]
        return kept

    def _best(self, parts: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each non-empty mask, the lowest index among equals, and its squared distance."""
        code, least = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        step = max(1, PAIR_VALUES // max(1, self.entries.size))
        for at in range(0, len(parts), step):
            bits = np.unpackbits(masks[at : at + step].astype("<u8").view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            gap = parts[at : at + step][row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", gap, gap)
            nearest = np.minimum.reduceat(distance, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
            hits = np.flatnonzero(distance == nearest[row])
            code[at : at + step] = entry[hits[np.searchsorted(row[hits], np.arange(len(nearest)))]]
            least[at : at + step] = nearest
        return code, least

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part."""
        code, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        radius, left = np.full(len(parts), self.radius), np.arange(len(parts))
        while len(left):
            masks = self.within(parts[left], radius[left])
            found = masks.any(axis=1)
            none, some = left[~found], left[found]
            radius[none] *= 2
            if len(some):
                code[some], least[some] = self._best(parts[some], masks[found])
                reach = np.ceil(np.sqrt(least[some].astype(np.float64))).astype(np.int64)
                more = reach > radius[some]
                radius[some] = np.maximum(radius[some], reach)
                some = some[more]
            left = np.concatenate([none, some])
        return code, least


@dataclass(frozen=True)
class Codebooks:
    """Entries as integers, by part, entry and position; without entries where no vector can be coded."""

    entries: np.ndarray
    size: int

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integers that a code stands for."""
        return [int(x) for part, entry in enumerate(bytes.fromhex(code)) for x in self.entries[part, entry]]


def usable(vector: str) -> Column:
    return F.coalesce(F.forall(vector, lambda x: F.abs(x) < float("inf")), F.lit(False))


def _integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    bound = math.isqrt((2**63 - 1) // (4 * size))
    with np.errstate(over="ignore"):
        scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    return np.clip(scaled, -bound, bound).astype(np.int64).reshape(-1, size)


def _parts(matrix: np.ndarray, books: Codebooks) -> list[np.ndarray]:
    return [matrix[:, part * books.width : (part + 1) * books.width] for part in range(len(books.entries))]


def _first_entries(vectors: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks:
    """The parts of the smallest keys' vectors. Tasks find their own smallest keys, so no table of keys is shuffled."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            column = batch.column(0) if held is None else pa.concat_arrays([held, batch.column(0)])
            held = column.unique().sort()[:entries]
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], [key])

    keys = vectors.select(key).filter(F.col(key).isNotNull())
    keys = [row[0] for row in keys.mapInArrow(smallest, keys.schema).distinct().orderBy(key).limit(entries).collect()]
    found = vectors.filter(F.col(key).isin(keys)).groupBy(key).agg(F.min(vector).alias("least")) if keys else None
    rows = [row.least for row in sorted(found.collect(), key=lambda row: row[0])] if keys else []
    size = len(rows[0]) if rows else 0
    if not size or size % parts:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), size)
    first = _integers(pa.array([row for row in rows if len(row) == size], pa.list_(pa.float64())), size, scale)
    return Codebooks(first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy(), size)


def _sums(vectors: DataFrame, vector: str, books: Codebooks, scale: int) -> DataFrame:
    """Count and componentwise sums of the parts nearest to each entry."""
    schema = "part int, entry int, n bigint, sums array<bigint>"
    count, width = books.entries.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(entries) for entries in books.entries]
        totals = np.zeros((len(slices), count, width + 1), np.int64)
        for batch in batches:
            for part, values in enumerate(_parts(_integers(batch.column(0), books.size, scale), books)):
                if len(values):
                    code = slices[part].nearest(values)[0]
                    order = np.argsort(code, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(code[order]) > 0])
                    rows = np.c_[np.ones(len(values), np.int64), values][order]
                    totals[part, code[order][starts]] += np.add.reduceat(rows, starts)
        part, entry = np.nonzero(totals[:, :, 0])
        met = totals[part, entry]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(met[:, 0]), pa.array(list(met[:, 1:]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "sums"])

    met = vectors.filter(F.size(vector) == books.size).select(vector).mapInArrow(run, schema)
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])
    return met.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums"))


def fit(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks:
    """Codebooks from all vectors: each round gives every part to its nearest entry, and every entry the floored mean of its parts."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so codebooks have 1 to 256 entries")
    kept = vectors.filter(usable(vector)).select(key, vector)
    books = _first_entries(kept, key, vector, parts, entries, scale)
    for _ in range(rounds if books.entries.size else 0):
        moved = books.entries.copy()
        for row in _sums(kept, vector, books, scale).collect():
            moved[row.part, row.entry] = np.array(row.sums, np.int64) // row.n
        books = Codebooks(moved, books.size)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: tuple[str, ...] = ("vec_id",), vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The columns ``keep`` of all usable vectors with ``code`` and ``error``, the squared distance from what the code stands for."""
    if {"code", "error"} & set(keep):
        raise ValueError("code and error are columns of the result; rename those to keep")
    kept = vectors.filter(usable(vector)).select(*[F.col(name) for name in keep], F.col(vector).alias("_vector"))
    schema = T.StructType(kept.schema.fields[:-1]).add("code", T.StringType()).add("error", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(entries) for entries in books.entries] if books.entries.size else []
        for batch in batches:
            column = batch.column(len(keep))
            fits = np.flatnonzero(column.value_lengths().to_numpy(zero_copy_only=False) == books.size) if slices else np.empty(0, np.int64)
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if len(fits):
                near = [s.nearest(p) for s, p in zip(slices, _parts(_integers(column.take(pa.array(fits)), books.size, scale), books), strict=True)]
                digits = np.stack([c for c, _ in near], axis=1).astype(np.uint8).tobytes().hex()
                step = 2 * len(slices)
                code[fits] = [digits[at : at + step] for at in range(0, len(digits), step)]
                error[fits] = sum(d for _, d in near)
            made = [pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], schema.names)

    return kept.mapInArrow(run, schema)


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings, their errors, and those errors summed over equal labels."""
    vectors = table(spark, sf_dir, "embeddings")
    books = fit(vectors)
    coded = settled(encode(vectors, books, keep=("vec_id", "label")), "vector-codes")
    # One row per label, added up in the map tasks: a frequent label is never gathered.
    by_label = settled(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, coded.label.eqNullSafe(by_label.label)).select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )


def _codes_sql(rounds: int = ROUNDS) -> str:
    """The same by comparing every part with every entry."""

    def assigned(n: int) -> str:
        return f"""assigned{n} AS MATERIALIZED (
  SELECT vec_id, label, part, any_value(v) AS v, min(d) AS d, min(struct_pack(d := d, entry := entry)).entry AS entry
  FROM (SELECT p.row_id, p.vec_id, p.label, p.part, p.v, b.entry,
               p.norm - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v) AS d
        FROM parts p JOIN book{n} b USING (part))
  GROUP BY row_id, vec_id, label, part)"""

    def moved(n: int) -> str:
        return f"""means{n} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS v FROM (
    SELECT part, entry, pos, floor(sum(v[pos]) / count(*)) AS mean
    FROM (SELECT part, entry, v, unnest(range(1, len(v) + 1)) AS pos FROM assigned{n}) GROUP BY part, entry, pos)
  GROUP BY part, entry),
book{n + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{n} b LEFT JOIN means{n} m USING (part, entry))"""

    steps = ",\n".join(f"{assigned(n)},\n{moved(n)}" for n in range(rounds))
    return f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row_id, vec_id, label, part, v, list_inner_product(v, v) AS norm FROM (
    SELECT row_id, vec_id, label, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v
    FROM kept, range({PARTS}) AS r(part))),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry
  FROM (SELECT DISTINCT vec_id FROM kept) ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS MATERIALIZED (SELECT part, entry, min(v) AS v FROM parts JOIN first_ids USING (vec_id) GROUP BY part, entry),
{steps},
{assigned(rounds)},
digest AS (
  SELECT sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM book{rounds})),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
  FROM assigned{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, digest"""


ORACLE_SQL = _codes_sql()
