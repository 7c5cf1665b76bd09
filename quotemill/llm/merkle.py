"""A Merkle manifest of a table: one tree per group of rows over their leaves in key order, and one over the groups' roots.

Parents keep, before each child's slot, a copy of their hash state (``Parent``). A changed child is folded by resuming
the state before its slot with the replacement and the siblings to its right; what lies to the left is never hashed again.

Hash states live in tasks only, so trees are built in blocks of ``BLOCK`` consecutive nodes: going up, each block gives
its root, which is a node of the next level; going down, each block is built again, with its states, below the path that
its root has to the top. Leaves move with two digests, never with their texts, and no task holds more than one block's tree.

Order and odd input: groups by their UTF-8 bytes, null first; rows of a group by key, null keys first, then by leaf. Rows
that repeat are leaves of their own beside each other. A null value counts as ``-``, which no other value can give. An empty
table gives an empty manifest. Only the columns that are asked for are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, table

ARITY = 2
BLOCK = 1024  # nodes whose tree a task holds at a time; a power of ARITY

PATH = "path array<struct<slot: int, siblings: array<string>>>"
_PATHS = pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))
NODES = "tree string, position bigint, total bigint, digest string"


class Parent:
    """A node above the given children, with a copy of the hash state before each of their slots."""

    def __init__(self, children: list[str]):
        self.children = children
        self.before = []
        state = hashlib.sha256()
        for child in children:
            self.before.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        """The digest with another child in this slot."""
        state = self.before[slot].copy()
        for child in (replacement, *self.children[slot + 1 :]):
            state.update(child.encode())
        return state.hexdigest()


class Tree:
    """The parents above consecutive nodes: until one is left, or for as many levels as are given."""

    def __init__(self, nodes: list[str], arity: int, height: int | None = None):
        self.arity = arity
        self.levels: list[list[Parent]] = []
        while len(self.levels) < height if height is not None else len(nodes) > 1:
            parents = [Parent(nodes[at : at + arity]) for at in range(0, len(nodes), arity)]
            self.levels.append(parents)
            nodes = [parent.digest for parent in parents]
        self.root = nodes[0]

    def above(self, place: int) -> list[tuple[Parent, int]]:
        """Parents of a node from the bottom to the root, each with the slot that leads to the node."""
        steps = []
        for parents in self.levels:
            place, slot = divmod(place, self.arity)
            steps.append((parents[place], slot))
        return steps


def _siblings(steps: list[tuple[Parent, int]]) -> list[dict]:
    return [{"slot": slot, "siblings": parent.children[:slot] + parent.children[slot + 1 :]} for parent, slot in steps]


def _resumed(digest: str, path: list[dict]) -> list[tuple[Parent, int]]:
    """The parents of a node made again from its digest and its path, with their hash states."""
    steps = []
    for step in path:
        slot, siblings = step["slot"], step["siblings"]
        parent = Parent([*siblings[:slot], digest, *siblings[slot:]])
        steps.append((parent, slot))
        digest = parent.digest
    return steps


def _folded(steps: list[tuple[Parent, int]], digest: str) -> str:
    for parent, slot in steps:
        digest = parent.folded(slot, digest)
    return digest


def field(value: Column) -> Column:
    """The bytes that stand for a value in a leaf: its length, a colon and itself as text, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ordered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """The rows with ``position``, their place in their tree from 0, and ``total``, the tree's number of rows.

    One range exchange by tree and order, which splits large trees; places within a task are added to counts of the tasks before.
    """
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, current, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for value in batch.column(names.index(tree)).to_pylist():
                current, n = value, (n + 1 if value == current and n else 1)
                places.append(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], [*names, "_task", "_place"])

    spread = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = settled(spread.mapInArrow(number, f"{_ddl(rows)}, _task int, _place bigint"), "merkle-order")
    tasks = placed.groupBy(tree, "_task").agg(F.count("*").alias("_n"))
    own = "sum(_n) OVER (PARTITION BY {0}".format(tree)
    before = settled(
        tasks.select(tree, "_task", F.expr(f"{own} ORDER BY _task) - _n").alias("_before"), F.expr(f"{own})").alias("total")), "merkle-counts"
    )
    return placed.join(before, [tree, "_task"]).select(*names, (F.col("_before") + F.col("_place")).alias("position"), "total")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / block))


def _tree_of(rows: pa.Table, arity: int, block: int) -> tuple[pa.Table, Tree]:
    """A block's rows in order and its tree. Beside other blocks it is folded as far as a whole block is, alone up to one node."""
    rows = rows.sort_by("position")
    height = None
    if rows.column("total")[0].as_py() > block:
        height, reach = 1, arity
        while reach < block:
            height, reach = height + 1, reach * arity
    return rows, Tree(rows.column("digest").to_pylist(), arity, height)


def _roots(nodes: DataFrame, arity: int, block: int) -> DataFrame:
    """The blocks' roots as the nodes of the next level."""

    def run(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1)
        total = -(-first.column("total")[0].as_py() // block)
        made = [first.column("tree"), first.column("block"), pa.array([total], pa.int64()), pa.array([_tree_of(rows, arity, block)[1].root])]
        return pa.table(made, ["tree", "position", "total", "digest"])

    return _in_blocks(nodes, block).groupBy("tree", "block").applyInArrow(run, NODES)


def _paths(nodes: DataFrame, upper: DataFrame, arity: int, block: int) -> DataFrame:
    """Each node's path to the top of all trees, below the paths that the blocks' roots have."""

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = _tree_of(rows.select(["tree", "position", "total", "digest"]), arity, block)
        end = above.to_pylist()[0]
        paths = [_siblings(tree.above(place)) + end["path"] for place in range(rows.num_rows)]
        made = [rows.column("tree"), rows.column("position"), pa.array(paths, _PATHS)]
        made += [pa.array([end[name]] * rows.num_rows, pa.string()) for name in ("subroot", "root")]
        return pa.table(made, ["tree", "position", "path", "subroot", "root"])

    return _below(nodes, upper, block).applyInArrow(run, f"tree string, position bigint, {PATH}, subroot string, root string")


def _below(nodes: DataFrame, upper: DataFrame, block: int):
    blocks = _in_blocks(nodes, block).groupBy("tree", "block")
    return blocks.cogroup(upper.withColumnRenamed("position", "block").groupBy("tree", "block"))


def _levels(nodes: DataFrame, arity: int, block: int) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of the blocks of those, until each tree has one."""
    levels = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        levels.append(settled(_roots(levels[-1], arity, block), "merkle-nodes"))
        most = -(-most // block)
    return levels


def manifest(rows: DataFrame, arity: int = ARITY, block: int = BLOCK) -> DataFrame:
    """Proofs of leaves given as rows (``tree``, ``key``, ``leaf``, ``changed``), where ``tree`` is null or a group's name.

    Returns each row with its ``path`` (per level the slot and the siblings, bottom first), the ``subroot`` of its tree, the
    ``root`` over all trees, and ``folded``, the root that comes out where its leaf is ``changed``.
    """
    if arity < 2 or block not in (arity**n for n in range(1, 64)):
        raise ValueError("a block is a power of the arity, and the arity is 2 or more")
    # A letter before each name, so that no tree is null and the null one comes first.
    named = rows.select(F.coalesce(F.concat(F.lit("n"), "tree"), F.lit("")).alias("tree"), "key", "leaf", "changed")
    leaves = ordered(settled(named, "merkle-leaves"), "tree", ["key", "leaf"])
    nodes = leaves.select("tree", "position", "total", F.col("leaf").alias("digest"))
    levels = _levels(nodes, arity, block)

    # The trees' roots are the nodes of one more tree; each carries its tree's name.
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = ordered(subroots, "tree", ["name"])
    top_levels = _levels(tops.select("tree", "position", "total", "digest"), arity, block)
    end = F.expr(f"CAST(array() AS {PATH.removeprefix('path ')})").alias("path")
    upper = top_levels[-1].select("tree", "position", end, F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for level in reversed(top_levels[:-1]):
        upper = _paths(level, upper, arity, block)
    upper = upper.select(F.col("position").alias("place"), "path", "root")
    upper = tops.join(upper, F.col("position") == F.col("place")).select(
        F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("position"), "path", F.col("digest").alias("subroot"), "root"
    )
    # A tree that is ready below the last level passes its root on, as a block of one node.
    for level in reversed(levels[1:-1]):
        upper = settled(_paths(level, upper, arity, block), "merkle-paths")

    def fold(own: pa.Table, above: pa.Table) -> pa.Table:
        own, tree = _tree_of(own, arity, block)
        end = above.to_pylist()[0]
        top = _resumed(tree.root, end["path"])
        places = [tree.above(place) + top for place in range(own.num_rows)]
        folded = [_folded(steps, changed) for steps, changed in zip(places, own.column("changed").to_pylist(), strict=True)]
        made = [own.column("key"), own.column("digest"), pa.array([_siblings(steps) for steps in places], _PATHS)]
        made += [pa.array([end[name]] * own.num_rows, pa.string()) for name in ("subroot", "root")]
        return pa.table([*made, pa.array(folded, pa.string())], ["key", "leaf", "path", "subroot", "root", "folded"])

    key = dict(rows.dtypes)["key"]
    below = _below(leaves.withColumnRenamed("leaf", "digest"), upper, block)
    return below.applyInArrow(fold, f"key {key}, leaf string, {PATH}, subroot string, root string, folded string")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and roots of every document; a seventh of them is tampered with and folded again."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    values = [F.col(name) for name in columns]
    more = [(F.col(name).cast("decimal(20,0)") + 1) if name == "n_chars" else F.col(name) for name in columns]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("tree"),
        F.col("doc_id").alias("key"),
        leaf(*values).alias("leaf"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf(*more)).alias("changed"),
    )
    leaves = leaves.withColumn("changed", F.coalesce("changed", "leaf"))
    siblings = F.flatten(F.transform("path", lambda step: step.siblings))
    return manifest(leaves).select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


ORACLE_SQL = """WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
fields AS (
  SELECT row_number() OVER () AS row_id, doc_id, lang, n_chars,
         [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS own,
         [doc_id::VARCHAR, source, lang, (n_chars::HUGEINT + 1)::VARCHAR, text] AS more,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS tampered
  FROM documents, crc_table),
hashed AS MATERIALIZED (
  SELECT row_id, doc_id, coalesce('n' || lang, '') AS tree,
         sha256(list_reduce(list_transform(own, lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b)) AS leaf,
         CASE WHEN tampered AND n_chars IS NOT NULL
              THEN sha256(list_reduce(list_transform(more, lambda v: coalesce(strlen(v) || ':' || v, '-')), lambda a, b: a || b))
         END AS changed
  FROM fields),
leaves AS MATERIALIZED (
  SELECT row_id, doc_id, tree, leaf, coalesce(changed, leaf) AS changed,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS total
  FROM hashed),
up AS (
  SELECT tree, 0 AS level, pos, total, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM up WHERE total > 1 GROUP BY tree, level, pos // 2, total),
tops AS MATERIALIZED (
  SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total
  FROM up WHERE total = 1),
over AS (
  SELECT 0 AS level, pos, total, subroot AS digest FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (total + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
  FROM over WHERE total > 1 GROUP BY level, pos // 2, total),
nodes AS MATERIALIZED (
  SELECT tree, level, pos, digest FROM up UNION ALL SELECT 'top', level, pos, digest FROM over),
fold AS (
  SELECT row_id, tree, 0 AS level, pos, total, changed AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT f.row_id, CASE WHEN f.total > 1 THEN f.tree ELSE 'top' END, CASE WHEN f.total > 1 THEN f.level + 1 ELSE 0 END,
         CASE WHEN f.total > 1 THEN f.pos // 2 ELSE t.pos END, CASE WHEN f.total > 1 THEN (f.total + 1) // 2 ELSE t.total END,
         CASE WHEN f.total = 1 THEN f.digest WHEN n.digest IS NULL THEN sha256(f.digest)
              WHEN f.pos % 2 = 0 THEN sha256(f.digest || n.digest) ELSE sha256(n.digest || f.digest) END,
         f.proof || coalesce(n.digest, '')
  FROM fold f LEFT JOIN nodes n ON n.tree = f.tree AND n.level = f.level AND n.pos = xor(f.pos, 1) AND f.total > 1
  LEFT JOIN tops t ON t.name = f.tree AND f.total = 1
  WHERE f.tree <> 'top' OR f.total > 1)
SELECT l.doc_id, l.leaf, t.subroot, r.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = r.digest AS verified
FROM leaves l JOIN tops t ON t.name = l.tree JOIN fold f ON f.row_id = l.row_id AND f.tree = 'top' AND f.total = 1,
     (SELECT digest FROM over WHERE total = 1) r"""
