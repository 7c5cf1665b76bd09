"""Vector codes, Merkle manifest and shards against brute force and SQL, and on odd tables."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from check_queries import canonical, compare, duck

from quotemill.llm import merkle, registered, sharding, vector_codes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, slot int, row string, `key` string"
VECTORS = "vec_id bigint, embedding array<double>, label int, code string, error int"


def documents(spark, tmp_path, rows):
    full = [(*row, "x", 1, "r", "k") for row in rows]
    spark.createDataFrame(full, DOCS).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


ODD = [
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (None, "no id", "en", "a", 5),
    (3, "same", "en", "a", 4),
    (4, "same", "en", "b", 4),
    (4, "same", "en", "b", 4),
    (4, "other", "en", "b", 2**63 - 1),
    (5, "é😀\x00" * 20_000, "zz", "b", 60_000),
    (-7, "x", "", "b", -1),
] + [(100 + i, "copy", "fr", "hot", 4) for i in range(60)]


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    problem, n = compare(spark, duck(sf_dir), sf_dir, name, registered.queries()[name], registered.oracle_sql()[name])
    assert not problem and n


def test_slices_find_the_nearest_entry_and_the_lowest_of_equals():
    rng = np.random.default_rng(5)
    for count, width, spread in ((256, 16, 300), (256, 3, 4), (70, 1, 10), (1, 5, 9), (64, 8, 1 << 27), (65, 2, 2)):
        entries = rng.integers(-spread, spread, (count, width))
        parts = np.concatenate([rng.integers(-2 * spread, 2 * spread, (300, width)), entries, entries[:1] + 1000])
        code, distance = vector_codes.Slices(entries).nearest(parts)
        every = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert code.tolist() == every.argmin(axis=1).tolist()
        assert distance.tolist() == every.min(axis=1).tolist()


def test_masks_hold_what_lies_in_the_box():
    rng = np.random.default_rng(6)
    entries, parts = rng.integers(-20, 20, (130, 4)), rng.integers(-20, 20, (40, 4))
    masks = vector_codes.Slices(entries).within(parts, np.full(40, 9))
    for part, mask in zip(parts, masks, strict=True):
        got = [i for i in range(130) if int(mask[i >> 6]) >> (i & 63) & 1]
        assert got == np.flatnonzero((np.abs(entries - part) <= 9).all(axis=1)).tolist()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v, _ in kept:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    width = len(least[min(least)]) // parts
    cut = [slice(p * width, (p + 1) * width) for p in range(parts)]
    books = [[least[i][c] for i in sorted(least)[:entries]] for c in cut]

    def near(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p, c in enumerate(cut):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(books[p], v[c])[1]].append(v[c])
            for n, members in groups.items():
                books[p][n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, label, [near(books[p], v[c]) for p, c in enumerate(cut)]) for i, v, label in kept]
    total = Counter()
    for _, label, found in coded:
        total[label] += sum(d for d, _ in found)
    return [(i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), total[label], digest) for i, label, found in coded]


def test_codes_equal_brute_force_on_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.normal(size=8).round(2).tolist(), int(i) % 3 or None) for i in rng.permutation(300)]
    rows += [rows[0], rows[0], (5, [9.0] * 8, 1), (None, [0.5] * 8, 2), (7, None, 1), (8, [float("nan")] + [0.0] * 7, 1)]
    rows += [(9, [None] + [0.0] * 7, 1), (10, [float("inf")] * 8, 1), (-1, [-0.0001] * 8, None)]
    spark.createDataFrame([(*row, "c", 0) for row in rows], VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_code_compression(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_codes(rows), key=repr)


def test_vectors_of_other_sizes_keep_their_rows_without_codes(spark, tmp_path):
    rows = [(i, [float(i), 0.0, 1.0, 2.0], 1, "c", 0) for i in range(5)] + [(9, [1.0], 1, "c", 0), (10, [], 2, "c", 0), (11, [3e300] * 4, 1, "c", 0)]
    vectors = spark.createDataFrame(rows, VECTORS)
    books = vector_codes.fit(vectors)
    coded = {row.vec_id: row for row in vector_codes.encode(vectors, books).collect()}
    assert coded[9].code is None and coded[10].error is None and coded[11].code
    assert books.decode(coded[2].code)[1:] == [0, 1024, 2048] and len(coded) == 8
    none = vector_codes.fit(vectors.filter("vec_id >= 9"))
    assert [row.code for row in vector_codes.encode(vectors, none).collect()] == [None] * 8
    vectors.filter("false").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op11_vector_code_compression(spark, str(tmp_path)).collect() == []
    with pytest.raises(ValueError):
        vector_codes.encode(vectors, books, keep=("vec_id", "code"))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    doc_id, text, lang, source, n_chars = row
    texts = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*("-" if v is None else f"{len(v.encode())}:{v}" for v in texts))


def climb(nodes, places, folded, proofs, arity):
    """One level up for nodes and for every leaf: its place, its folded digest and its siblings so far."""
    for leaf, place in places.items():
        run = place - place % arity
        siblings = [n for i, n in enumerate(nodes[run : run + arity]) if i != place % arity]
        proofs[leaf] += "".join(siblings)
        folded[leaf] = digest(*siblings[: place % arity], folded[leaf], *siblings[place % arity :])
        places[leaf] = place // arity
    return [digest(*nodes[at : at + arity]) for at in range(0, len(nodes), arity)]


def plain_manifest(rows, arity=2):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    names = sorted(trees, key=lambda name: (name is not None, (name or "").encode()))
    proofs, folded, leaves, subroots = {}, {}, {}, {}
    for name in names:
        members = sorted(trees[name], key=lambda row: (row[0] is not None, row[0] or 0, plain_leaf(row)))
        nodes, places = [plain_leaf(row) for row in members], {}
        for i, row in enumerate(members):
            key = (name, i)
            changed = row[4] is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            leaves[key], places[key], proofs[key] = (row[0], nodes[i]), i, ""
            folded[key] = plain_leaf((*row[:4], row[4] + 1)) if changed else nodes[i]
        while len(nodes) > 1:
            nodes = climb(nodes, places, folded, proofs, arity)
        subroots[name] = nodes[0]
    nodes, places = [subroots[name] for name in names], {key: names.index(key[0]) for key in leaves}
    while len(nodes) > 1:
        nodes = climb(nodes, places, folded, proofs, arity)
    return [(leaves[k][0], leaves[k][1], subroots[k[0]], nodes[0], digest(proofs[k]), folded[k], folded[k] == nodes[0]) for k in leaves]


def test_manifest_equals_brute_force_on_odd_rows(spark, tmp_path):
    got = merkle.op12_merkle_manifest(spark, documents(spark, tmp_path, ODD)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_manifest(ODD), key=repr)
    assert Counter(row.verified for row in got)[False] > 0


def test_manifest_of_nothing(spark, tmp_path):
    assert merkle.op12_merkle_manifest(spark, documents(spark, tmp_path, [])).collect() == []


@pytest.mark.parametrize(("arity", "block"), [(2, 4), (2, 2), (3, 9), (4, 4)])
def test_blocks_do_not_change_the_tree(spark, arity, block):
    """Many small blocks give several levels of them, in the groups' trees and in the one above."""
    rows = [(i, f"t{i}", f"g{i % 23}" if i % 2 else "big", "s", i) for i in range(150)]
    given = [(row[2], row[0], plain_leaf(row), plain_leaf((*row[:4], row[4] + 1)) if zlib.crc32(str(row[0]).encode()) % 7 == 0 else plain_leaf(row)) for row in rows]
    frame = spark.createDataFrame(given, "tree string, key bigint, leaf string, changed string")
    got = [
        (r.key, r.leaf, r.subroot, r.root, digest(*(s for step in r.path for s in step.siblings)), r.folded, r.folded == r.root)
        for r in merkle.manifest(frame, arity, block).collect()
    ]
    assert sorted(got) == sorted(plain_manifest(rows, arity))


def test_a_parent_resumes_the_state_before_the_slot():
    children = [digest(str(i)) for i in range(5)]
    parent = merkle.Parent(children)
    assert parent.digest == digest(*children)
    for slot in range(5):
        assert parent.folded(slot, "new") == digest(*children[:slot], "new", *children[slot + 1 :])
        assert parent.folded(slot, children[slot]) == parent.digest
    with pytest.raises(ValueError):
        merkle.manifest(None, 2, 6)


def check_shards(got, rows, shards=24, tolerance=sharding.TOLERANCE):
    """Every row once, slots without gaps, bytes near equal, and equal texts together unless their group is heavy."""
    want = Counter((row[0], len((row[1] or "").encode()) + 8, zlib.crc32((row[1] or "").encode())) for row in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, size = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(size.values()) / shards
    group = Counter()
    for r in got:
        group[r.text_crc32] += r.size
    one = max((r.size for r in got), default=0)
    assert all(abs(size[s] - share) <= max(2 * tolerance * share, 2 * one) for s in range(shards))
    for crc, whole in group.items():
        if whole < tolerance * share:
            assert len({r.shard for r in got if r.text_crc32 == crc}) == 1


def test_shards_on_the_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_shards(sharding.op13_sharding(spark, sf_dir).collect(), rows)


@pytest.mark.parametrize("copies", [0, 3000])
def test_shards_on_odd_rows(spark, tmp_path, copies):
    """A third of all rows is one row repeated: its group is cut, and nothing is lost."""
    rows = ODD + [(1000 + i, f"text {i} " * (i % 50), "en", "s", 1) for i in range(2 * copies)] + [(7, "again and again", "en", "s", 1)] * copies
    check_shards(sharding.op13_sharding(spark, documents(spark, tmp_path, rows)).collect(), rows)


def test_shards_of_nothing_and_of_rows_without_a_place(spark, tmp_path):
    assert sharding.op13_sharding(spark, documents(spark, tmp_path, [])).collect() == []
    with pytest.raises(ValueError, match="read from a table"):
        sharding.assign(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))


def test_shards_are_the_same_for_the_same_table_and_cut_into_small_ranges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = sharding.assign(docs, 5, range_bytes=2000).select("row.doc_id", "shard", "slot").toPandas()
    again = sharding.assign(docs, 5, range_bytes=2000).select("row.doc_id", "shard", "slot").toPandas()
    assert canonical(once) == canonical(again)
    slots = once.groupby("shard").slot
    assert (slots.max() + 1 == slots.count()).all() and (slots.nunique() == slots.count()).all()


def test_every_cell_is_counted_below_its_boundary(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), 1, int(s)) for a, b, s in zip(rng.integers(-5, 5, 500) << 60, rng.integers(-9, 9, 500), rng.integers(1, 99, 500), strict=True)]
    keys = spark.createDataFrame(rows, "key1 bigint, key2 bigint, key3 bigint, size bigint")
    whole = [((a + 2**63) << 128) + ((b + 2**63) << 64) + c + 2**63 for a, b, c, _ in rows]
    boundaries = sorted(set(whole[::40]) | {whole[0] + 1})
    size, n, _ = sharding.counted(keys, boundaries)
    for i, boundary in enumerate(boundaries):
        below = [r[3] for r, key in zip(rows, whole, strict=True) if key < boundary]
        assert (size[i], n[i]) == (sum(below), len(below))
