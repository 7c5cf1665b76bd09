"""Packing: documents' token ids into sequences of bounded length, by best fit decreasing.

A document is cut into full windows and a remainder, by its length alone. Pieces, a few numbers each, are then dealt to
tasks by hash, where each task sorts its own by decreasing length and packs them: a segment tree over the remaining
capacities finds the tightest open window that a piece fits. The tree has one leaf per capacity, so its size depends on
the sequence length only; windows with the same capacity wait on one stack.

Null and empty texts are a document of the end id alone. Long texts are tokenised whole. Repeated rows are packed each
for itself, pieces of equal length go by doc_id and start, an empty table gives an empty one, and other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rest, settled, steps, table, texts

SEQUENCE = 2048
END_ID = 1
#: Pieces that one task packs, about: with many at hand the windows fill without gaps.
PIECES_PER_TASK = 200_000
#: Parts of words whose ids a worker keeps.
CACHED_PARTS = 300_000
#: Bytes of text that are tokenised in one go.
STEP_BYTES = 3_000_000

#: The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on.
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}

#: Texts whose parts are found by numpy: printable ASCII, white space, letters of Latin-1.
PLAIN = re.compile(rb"(?:[\t-\r -~]++|(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++)*+")
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Bytes of such texts in lower case (0x80 to 0x9E end capitals of Latin-1), and their kinds: white space, letter, digit, other.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
KIND = bytes(0 if b <= 32 else 1 if 97 <= b <= 122 or b >= 0x80 else 2 if 48 <= b <= 57 else 3 for b in range(256))

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class PartIds:
    """Token ids of whole texts, by way of the parts (letter runs, digits, punctuation) that the tokenizer works on one by one.

    The tokenizer puts letters in lower case, drops white space and never joins across parts. So the distinct parts of many
    texts are looked up once each, and their ids put together by numpy. Parts seen before are kept, in bounded number.
    Texts with characters beyond printable ASCII and the letters of Latin-1, or with its special tokens, go to the
    tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = self.tokenizer.model.tokenize
        self.kept: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}

    def part(self, part: bytes) -> bytes:
        """Its ids, four bytes each, which take a fraction of an array's memory. Of the parts kept, the half not met lately goes."""
        if 2 * len(self.kept) >= CACHED_PARTS:
            self.kept, self.earlier = {}, self.kept
        ids = self.earlier.get(part)
        if ids is None:
            shown = part.decode("latin-1")  # printable ASCII stands for itself
            tokens = self.tokens(shown if part.isascii() else shown.translate(BYTE_CHARS))
            ids = array("I", [token.id for token in tokens]).tobytes()
        self.kept[part] = ids
        return ids

    def of(self, values: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(values)
        plain = [i for i, value in enumerate(values) if PLAIN.fullmatch(value) and b"<|" not in value]
        for i, ids in zip(plain, self.of_plain([values[i] for i in plain]), strict=True):
            out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = np.array(self.tokenizer.encode(values[i].decode(), add_special_tokens=False).ids, np.uint32)
        return out

    def of_plain(self, values: list[bytes]) -> list[np.ndarray]:
        if not values:
            return []
        data, starts, before = split_parts(values)
        if not len(starts):
            return [np.empty(0, np.uint32)] * len(values)
        offsets = np.r_[starts, len(data)].astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        known = self.kept.get
        ids = [found if (found := known(part)) is not None else self.part(part) for part in byte_list(coded.dictionary)]
        flat = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        which = coded.indices.to_numpy()
        length = size[which]
        until = np.cumsum(length, dtype=np.int32)  # a step's ids are fewer than its bytes, which Arrow's offsets bound
        source = np.repeat((np.cumsum(size, dtype=np.int32) - size)[which] - (until - length), length)
        source += np.arange(len(source), dtype=np.int32)
        all_ids = flat[source]
        until = np.r_[0, until]
        return [all_ids[until[i] : until[j]] for i, j in zip(before[:-1], before[1:], strict=True)]


def byte_list(values: pa.LargeBinaryArray) -> list[bytes]:
    """Arrow's own list is made value by value."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def split_parts(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all parts in lower case without white space, where each part starts, and the number of parts before each text."""
    lower = (b" ".join(values) + b" ").translate(LOWER)
    data, kind = np.frombuffer(lower, np.uint8), np.frombuffer(lower.translate(KIND), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1)
    space = kind == 0
    start = np.empty(len(data), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == 2
    for at in np.flatnonzero((data == 39) & start):  # an apostrophe that begins a part may begin a contraction
        for tail in CONTRACTIONS:
            if lower.startswith(tail, at + 1):
                start[at + 1] = False
                if not space[after := at + 1 + len(tail)]:
                    start[after] = True
                break
    start &= ~space
    solid = ~space
    at = np.flatnonzero(start)
    place = np.cumsum(solid, dtype=np.int32)[at] - 1  # among the bytes kept
    return data[solid], place, np.r_[0, np.searchsorted(at, ends)]


@lru_cache(maxsize=2)
def part_ids(path: str) -> PartIds:
    return PartIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class CapacityTree:
    """Counts of open windows by remaining capacity, in a segment tree; finds the smallest capacity not below a need."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node, counts = self.leaves + capacity, self.counts
        while node:
            counts[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of an open window that holds ``need``, or -1."""
        node, counts = self.leaves + need, self.counts
        if counts[node]:
            return need
        while node > 1 and (node & 1 or not counts[node + 1]):  # up until a right neighbour has windows
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:
            node = 2 * node + (not counts[2 * node])
        return node - self.leaves


def best_fit(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Window and offset of each piece, for pieces in order of decreasing length."""
    tree, waiting, fresh, placed = CapacityTree(size), [[] for _ in range(size + 1)], 0, []
    for length in lengths:
        capacity = tree.tightest(length)
        if capacity < 0:
            window, capacity, fresh = fresh, size, fresh + 1
        else:
            window = waiting[capacity].pop()
            tree.add(capacity, -1)
        placed.append((window, size - capacity))
        if capacity > length:
            waiting[capacity - length].append(window)
            tree.add(capacity - length, 1)
    return placed


def cut(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: full windows, then what remains."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = part_ids(path)
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                rows = []
                values = [value.encode() for value in texts(part)]
                for doc, own in zip(part.column("doc_id").to_pylist(), ids.of(values), strict=True):
                    data = memoryview(own.astype("<u4").tobytes() + end)
                    total = len(data) // 4
                    rows += [(doc, at, min(size, total - at), zlib.crc32(data[4 * at : 4 * (at + size)]), total) for at in range(0, total, size)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        rest()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, size: int = SEQUENCE, pieces_per_task: int = PIECES_PER_TASK) -> DataFrame:
    """The pieces with sequence_id and offset. The pieces are counted, so they should be settled."""
    tasks = max(1, -(-pieces.count() // pieces_per_task))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        own = pa.Table.from_batches(rows)
        placed = best_fit(own.column("length").to_pylist(), size)
        first = TaskContext.get().partitionId() << 40
        columns = np.array(placed, np.int64).reshape(-1, 2)
        own = own.append_column("sequence_id", pa.array(columns[:, 0] + first)).append_column("offset", pa.array(columns[:, 1]))
        yield from own.to_batches()

    dealt = pieces.repartition(tasks, "doc_id", "start", "ids_crc32")
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32", "doc_tokens")
    return ordered.mapInArrow(run, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, size: int = SEQUENCE, tokenizer: str | None = None) -> DataFrame:
    return pack(settled(cut(docs, size, tokenizer), "pieces"), size)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
