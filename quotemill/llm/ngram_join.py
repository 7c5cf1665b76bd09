"""N-gram Jaccard join: documents whose sets of word shingles are alike, by prefix filters under several global orders.

1. A sketch counts all documents' shingles in a fixed number of cells. Every order puts shingles of less filled cells
   first and breaks ties by a hash of its own, so shared passages come last. A sketch that counts roughly costs
   selectivity only: any order that all documents share finds all links.
2. Documents with the same set form a class; one of them stands for it.
3. Two classes that link share a shingle within their prefixes, under every order. In the first order, candidates must
   also meet at a place that leaves enough shingles behind it, and share EXTRA + 1 shingles within prefixes longer by
   EXTRA. They must then share a prefix shingle under each of the other orders, and what is left is verified on the whole
   sets, which only the classes that got so far are asked for.
4. To find components it is enough to verify a spanning part of the links. First each class is compared with one leader,
   the class in whose prefix their shared shingles stand foremost. After that only candidates of different components
   are, so a large group of copies costs about one comparison each, not one for each pair.

Texts without words (or null) have empty sets and stay alone. With fewer words than a shingle the whole sequence is one.
Texts are read whole. Repeated rows give repeated result rows in one component, an empty table gives an empty one, null
keys stay alone, and other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, rest, settled, steady, steps, table, texts, words

#: Bits of the sketch's cell numbers. It is broadcast with two bytes a cell.
SKETCH_BITS = 20
CHUNK = 1 << 14
ORDERS = 3
#: Shingles by which the first order's prefixes are longer than needed for one meeting.
EXTRA = 8
CACHED_WORDS = 100_000
STEP_BYTES = 2_000_000

A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    h = h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def forget() -> None:
    """At the end of a task: the worker lives on, and may wait for long."""
    HASHES.clear()
    rest()


def shingle_sets(values: list[str], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes."""
    split = [words(value) for value in values]
    counts = [len(own) for own in split]
    word = np.fromiter((HASHES[w] for own in split for w in own), np.uint64, sum(counts))
    h = np.zeros(max(0, len(word) - size + 1), np.uint64)
    for i in range(size):
        h = mix(h * A + word[i : i + len(h)] + B)
    out, at = [], 0
    for count in counts:
        if count >= size:
            out.append(np.unique(h[at : at + count - size + 1]))
        elif count:
            whole = C
            for x in word[at : at + count]:
                whole = mix(np.array([whole]) * A + x + np.uint64(count))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out


def least_overlap(size: int, percent: int) -> int:
    """Shingles that any linked set shares with one of this size."""
    return -(-percent * size // 100)


def sketch(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Classes of how often the shingles of each cell occur, over all documents."""
    cells = 1 << bits
    chunks = max(1, cells // CHUNK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(cells, np.int64)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                found = [s for s in shingle_sets(texts(part), size) if len(s)]
                if found:
                    own += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=cells)
        forget()
        for i, chunk in enumerate(np.split(own, chunks)):
            if chunk.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": pa.array([narrow(chunk)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + wide(counts)
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([narrow(total)], pa.binary())})

    kind = "chunk int, counts binary"
    summed = docs.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind)
    out = np.zeros((chunks, cells // chunks), np.uint16)
    for row in summed.toLocalIterator():  # 2 ** bits cells in all
        out[row["chunk"]] = np.log2(1 + wide(row["counts"])) * 16
    return out.reshape(-1)


def narrow(counts: np.ndarray) -> bytes:
    """The counts in four bytes each where they fit, else in eight."""
    return b"4" + counts.astype("<u4").tobytes() if counts.max() < 1 << 32 else b"8" + counts.astype("<i8").tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4" if data[:1] == b"4" else "<i8", offset=1).astype(np.int64)


def prefixes(own: np.ndarray, rarity: np.ndarray, bits: int, percent: int, orders: range) -> list[np.ndarray]:
    """The shingles of a set that come first in each order, as many as a linked set must touch; in the first order EXTRA more."""
    length = len(own) - least_overlap(len(own), percent) + 1 if len(own) else 0
    cell = rarity[(own >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64) << np.uint64(48)
    out = []
    for order in orders:
        key = cell | mix(own, order + 1) >> np.uint64(16)
        out.append(own[np.argsort(key, kind="stable")[: length + EXTRA * (order == 0)]].view(np.int64))  # ties go by the hash itself
    return out


def signatures(docs: DataFrame, key: str, size: int, percent: int, rarity, bits: int, whole: bool) -> DataFrame:
    """For each row the key, the size and digest of its set, and its prefix in the first order; ``whole``: the set and the other prefixes."""
    orders = range(1, ORDERS) if whole else range(1)
    names = ["members", *(f"prefix{o}" for o in orders)] if whole else ["digest", "prefix0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                sets = shingle_sets(texts(part), size)
                first = [x.view(np.int64) if whole else hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                rest = zip(*(prefixes(x, rarity.value, bits, percent, orders) for x in sets), strict=True)
                columns = [pa.array(first, pa.list_(pa.int64()) if whole else pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in rest)]
                sizes = pa.array(list(map(len, sets)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(key), sizes, *columns], [key, "n_shingles", *names])
        forget()

    kinds = ["array<bigint>" if x != "digest" else "binary" for x in names]
    schema = f"{key} bigint, n_shingles bigint, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return docs.select(F.col(key).cast("bigint").alias(key), "text").mapInArrow(run, schema)


def may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m shingles can link that first meet at the places i and j of their prefixes."""
    together = (100 + percent) * F.least(n - i, m - j) >= percent * (n + m)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & together


def side(sets: DataFrame, k: str, *names: str) -> DataFrame:
    return sets.select(F.col("id").alias(k), *(F.col(x).alias(f"{x}_{k}") for x in names))


def crowded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose longer prefixes in the first order share as many shingles as those of a link."""
    both = pairs.join(side(classes, "a", "n_shingles", "prefix0"), "a").join(side(classes, "b", "n_shingles", "prefix0"), "b")
    least = F.ceil(F.lit(percent) * F.greatest("n_shingles_a", "n_shingles_b") / 100)
    return both.filter(F.size(F.array_intersect("prefix0_a", "prefix0_b")) >= F.least(F.lit(EXTRA + 1), least)).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, key: str, size: int, percent: int, rarity, bits: int) -> DataFrame:
    """The pairs (a, b) that share prefix shingles in the other orders and then link by their whole sets."""
    near = settled(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct(), "wanted")
    own = docs.select(F.col(key).cast("bigint").alias(key), "text").join(beside(near), key, "left_semi")
    sets = settled(signatures(own, key, size, percent, rarity, bits, whole=True).withColumnRenamed(key, "id"), "sets")
    repeated = sets.groupBy("id").count().filter("count > 1").select("id")  # a shuffle of keys, where one of texts is seldom needed
    if not repeated.isEmpty():
        sets = settled(sets.dropDuplicates(["id"]), "sets")
    rest = [f"prefix{o}" for o in range(1, ORDERS)]
    near = pairs.join(side(sets, "a", *rest), "a").join(side(sets, "b", *rest), "b")
    near = near.filter(reduce(Column.__and__, (F.arrays_overlap(f"{x}_a", f"{x}_b") for x in rest))).select("a", "b")
    whole = near.join(side(sets, "a", "members"), "a").join(side(sets, "b", "members"), "b")
    common = F.size(F.array_intersect("members_a", "members_b"))
    union = F.size("members_a") + F.size("members_b") - common
    return whole.filter(100 * common >= percent * union).select("a", "b")


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(id, component): the smallest id that each end of an edge reaches; ends of no edge are left out.

    Each round every node takes the smallest label around it and then the label of its label, so labels travel twice as
    far each time. The edges and labels stay in written tables; only counts come to the driver.
    """
    edges = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), purpose)
    labels = settled(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), purpose)
    while True:
        around = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        own = labels.join(around, labels["id"] == around["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("next"))
        moved = settled(own.join(jump, "new").select("id", "old", F.least("new", "next").alias("component")), purpose)
        labels = moved.select("id", "component")
        if moved.filter("old != component").isEmpty():
            return labels


def link_components(docs: DataFrame, key: str = "doc_id", size: int = 3, percent: int = 90, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(key, n_shingles, component_id) for every row."""
    steady(docs.sparkSession)
    rarity = docs.sparkSession.sparkContext.broadcast(sketch(docs, size, sketch_bits))
    signed = settled(signatures(docs, key, size, percent, rarity, sketch_bits, whole=False), "signatures")
    some = signed.filter((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    classes = settled(some.groupBy("digest").agg(F.min(key).alias("id")), "classes")
    one = some.select(F.col(key).alias("id"), "n_shingles", "prefix0").join(classes.select("id"), "id", "left_semi").dropDuplicates(["id"])
    one = settled(one, "prefixes")
    needed = F.col("n_shingles") - F.ceil(F.lit(percent) * F.col("n_shingles") / 100) + 1
    entries = one.select("id", F.col("n_shingles").alias("n"), F.posexplode(F.slice("prefix0", F.lit(1), needed.cast("int"))).alias("at", "shingle"))

    common = entries.groupBy("shingle").count().filter("count > 1").select("shingle")
    shared = settled(entries.join(common, "shingle", "left_semi"), "shared")
    leaders = shared.groupBy("shingle").agg(F.min(F.struct("at", "n", "id")).alias("leader"))
    followers = shared.join(leaders, "shingle")
    able = may_link(F.col("n"), F.col("at"), F.col("leader.n"), F.col("leader.at"), percent)
    led = followers.filter((F.col("id") != F.col("leader.id")) & able).groupBy("id", F.col("leader.id").alias("leader")).count()
    best = led.groupBy("id").agg(F.min(F.struct((-F.col("count")).alias("few"), "leader")).alias("best"))
    stars = best.select(F.least("id", "best.leader").alias("a"), F.greatest("id", "best.leader").alias("b")).distinct()

    check = lambda pairs, of: settled(verified(settled(crowded(pairs, one, percent), "near"), docs, key, size, percent, rarity, sketch_bits), of)
    star_links = check(stars, "links")
    joined = components(star_links)

    placed = shared.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("shingle").agg((F.min("component") != F.max("component")).alias("mixed")).filter("mixed").select("shingle")
    placed = settled(placed.join(mixed, "shingle"), "places")
    # In a pair the smaller set meets the other early in its prefix, where less of it may lie before the meeting.
    early = placed.filter((100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n"))
    x, y = early.alias("x"), placed.alias("y")
    ordered = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    meets = may_link(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), percent)
    across = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & ordered & meets)
    pairs = across.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    final = components(star_links.union(check(pairs, "links")))

    of_class = classes.join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    result = signed.drop("prefix0").join(of_class, "digest", "left")
    return result.select(key, "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", key)).otherwise(F.col(key)).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """Of each component the row with the smallest key; rows that repeat a key count as copies of it."""
    kept = link_components(docs, key, **settings).filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_kept")).distinct()
    own = docs.withColumn("_kept", F.col(key).cast("bigint"))
    whole = own.filter(F.col("_kept").isNull()).drop("_kept")
    return own.join(kept, "_kept", "left_semi").dropDuplicates(["_kept"]).drop("_kept").unionByName(whole)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS own
  FROM texts),
shingles AS MATERIALIZED (SELECT doc_id, len(own) AS n, unnest(own) AS shingle FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT a, b FROM ways
  UNION
  SELECT r.a, w.b FROM reached r JOIN ways w ON r.b = w.a)
SELECT doc_id, len(own) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reached r WHERE r.a = doc_id), doc_id)) AS component_id
FROM sets"""
