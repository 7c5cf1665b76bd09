"""Benchmark decontamination: an FM-index per shard of the training texts, searched backward for every benchmark window.

A shard is a bounded run of documents within a task. Its words become symbols of the benchmark's vocabulary. A word that no
window holds ends a run of symbols, and runs shorter than the shortest window cannot hold one and need no place in the
index. Over the rest the suffix order gives the Burrows-Wheeler text, a wavelet tree of its bits gives ranks, and every
eighth suffix position is sampled. All windows are searched at once, from their last word to
the first; occurrences are located by walking to a sampled position, and spans that touch or overlap are merged.

The windows reach the tasks in blocks of bounded size, one pass over the documents for each block.

Null and empty texts have no words and no hits; items without words have no window. Texts are searched whole. Each row is
judged alone, so repeated rows get equal results; repeated items or item texts count by item_id. Empty tables give no rows
(documents) or no hits (benchmark). Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settled, table, texts, with_struct

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of a text with A-Z in lower case
WINDOW = 13
SHARD_BYTES = 4_000_000
SAMPLE_EVERY = 8
#: Benchmark words in one block, which bounds what is broadcast.
BLOCK_WORDS = 100_000

FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("first", T.ArrayType(T.LongType())),
        T.StructField("last", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class Wavelet:
    """Ranks over a sequence of symbols: one bit vector per binary digit, most significant first (a wavelet matrix)."""

    def __init__(self, symbols: np.ndarray, digits: int):
        self.levels = []
        for digit in range(digits - 1, -1, -1):
            bit = (symbols >> digit) & 1
            ones = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)])
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((digit, ones, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, until: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(until), until
        for digit, ones, zeros in self.levels:
            one = ((symbol >> digit) & 1).astype(bool)
            low_ones, high_ones = ones[low], ones[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low

    def symbol(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for digit, ones, zeros in self.levels:
            one = ones[at + 1] - ones[at]
            value |= one << digit
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return value


class FMIndex:
    """Over symbols from 1 up, with a 0 after each run of them. Separators differ from each other, by their place."""

    def __init__(self, symbols: np.ndarray, size: int):
        n, gap = len(symbols), symbols == 0
        gaps = int(gap.sum())
        rank, span, order = np.where(gap, np.cumsum(gap) - 1, gaps - 1 + symbols.astype(np.int64)), 1, None
        while True:  # ranks by 1, 2, 4, ... symbols, until no two suffixes tie
            second = np.zeros(n, np.int64)
            second[: max(0, n - span)] = rank[span:] + 1
            key = rank * (max(n, gaps + size) + 2) + second
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            if new[-1] == n - 1:
                break
            span *= 2
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size + 1))])  # smaller symbols
        bwt = symbols[order - 1]  # position 0 is preceded by the last symbol, a separator
        self.wavelet = Wavelet(bwt.astype(np.int32), max(1, int(size).bit_length()))
        self.marked = (order % SAMPLE_EVERY == 0) | (bwt == 0)  # at the start of a run stepping back would end
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]
        self.size = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the phrases, rows of symbols aligned to the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            live = live[(lengths[live] >= phrases.shape[1] - column) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, column]
            low[live] = self.before[symbol] + self.wavelet.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.wavelet.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by stepping back to the sampled ones."""
        at, steps, out, left = rows.copy(), 0, np.empty(len(rows), np.int64), np.arange(len(rows))
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.samples[self.mark_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            if len(left):
                symbol = self.wavelet.symbol(at)
                at = self.before[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out


class Windows:
    """The distinct windows of a block of items, as symbols, and the items that hold each."""

    def __init__(self, items: list[tuple[str, str]]):
        self.symbols: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            own = [self.symbols.setdefault(word, len(self.symbols) + 1) for word in WORD.findall(text.encode().lower())]
            size = min(WINDOW, len(own))
            for at in range(len(own) - size + 1) if own else ():
                held.setdefault(tuple(own[at : at + size]), set()).add(item)
        self.items = [sorted(x) for x in held.values()]
        self.lengths = np.fromiter(map(len, held), np.int64, len(held))
        self.shortest = int(self.lengths.min(initial=WINDOW))
        self.longest = int(self.lengths.max(initial=1))
        self.phrases = np.zeros((len(held), self.longest), np.int64)
        for row, phrase in enumerate(held):
            self.phrases[row, self.longest - len(phrase) :] = phrase

    def find(self, batch: pa.RecordBatch) -> list:
        """For each text the number of words, merged spans of words (last inclusive), and the items found."""
        get = self.symbols.get
        counts, coded = [], []
        for text in texts(batch):
            own = WORD.findall(text.encode().lower())
            counts.append(len(own))
            coded.append(np.fromiter((get(word, 0) for word in own), np.int32, len(own)))
        first, last, items = ([[] for _ in counts] for _ in range(3))
        starts = np.cumsum(np.array(counts, np.int64) + 1) - np.array(counts, np.int64) - 1  # a separator after each text
        symbols = np.concatenate([np.append(x, 0) for x in coded]).astype(np.int32) if coded else np.empty(0, np.int32)
        kept = self.long_runs(symbols)
        if len(kept) and len(self.lengths):
            index = FMIndex(symbols[kept], len(self.symbols))
            low, high = index.search(self.phrases, self.lengths)
            number = np.maximum(high - low, 0)
            which = np.repeat(np.arange(len(number)), number)
            rows = np.arange(number.sum()) + np.repeat(low - (np.cumsum(number) - number), number)
            at = kept[index.locate(rows)]
            doc = np.searchsorted(starts, at, side="right") - 1
            self.collect(doc, at - starts[doc], which, first, last, items)
        return [counts, first, last, items]

    def long_runs(self, symbols: np.ndarray) -> np.ndarray:
        """Positions in runs of known words that a window may fit in, each run with the separator after it."""
        known = np.concatenate([[False], symbols > 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edges[::2], edges[1::2]
        long = end - begin >= self.shortest
        begin, size = begin[long], end[long] - begin[long] + 1
        return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)

    def collect(self, doc: np.ndarray, at: np.ndarray, which: np.ndarray, first: list, last: list, items: list) -> None:
        order = np.lexsort((at, doc))
        for k in order.tolist():
            d, start, end = int(doc[k]), int(at[k]), int(at[k] + self.lengths[which[k]] - 1)
            if last[d] and start <= last[d][-1] + 1:
                last[d][-1] = max(last[d][-1], end)
            else:
                first[d].append(start)
                last[d].append(end)
        pairs = np.unique(np.stack([doc, which]), axis=1) if len(doc) else np.empty((2, 0), np.int64)
        for d, w in pairs.T.tolist():
            items[d].extend(self.items[w])
        for d in set(pairs[0].tolist()):
            items[d] = sorted(set(items[d]))


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about BLOCK_WORDS words; the driver holds one block at a time."""
    rows, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null and item_id is not null").toLocalIterator():
        rows.append((item, text))
        size += len(text.split())
        if size >= BLOCK_WORDS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def merge_spans(first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    out: tuple[list[int], list[int]] = ([], [])
    for start, end in sorted(zip(first, last, strict=True)):
        if out[1] and start <= out[1][-1] + 1:
            out[1][-1] = max(out[1][-1], end)
        else:
            out[0].append(start)
            out[1].append(end)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, into: str = "found") -> DataFrame:
    """The rows with a struct of n_words, merged spans of hit words (first, last), and the items found."""
    context = docs.sparkSession.sparkContext
    out, passes = docs, 0
    for items in blocks(benchmark):
        if passes:  # else all blocks would be held by the tasks of one plan
            out = settled(out, "searched")
        out = with_struct(out, into, FIELDS, _search(context.broadcast(Windows(items)), into, passes > 0), size=SHARD_BYTES)
        passes += 1
    return out if passes else with_struct(out, into, FIELDS, Windows([]).find, size=SHARD_BYTES)


def _search(windows, into: str, again: bool):
    """One pass; a later one joins its spans and items with those found before."""

    def make(batch: pa.RecordBatch) -> list:
        counts, first, last, items = windows.value.find(batch)
        for d, old in enumerate(batch.column(into).to_pylist() if again else ()):
            first[d], last[d] = merge_spans([*old["first"], *first[d]], [*old["last"], *last[d]])
            items[d] = sorted({*old["items"], *items[d]})
        return [counts, first, last, items]

    return make


def hit_words(found: str) -> F.Column:
    pairs = F.zip_with(f"{found}.first", f"{found}.last", lambda a, b: b - a + 1)
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda x, y: x + y)


def is_contaminated(found: str) -> F.Column:
    """At least one word in twenty lies in an occurrence of a window."""
    return (hit_words(found) > 0) & (20 * hit_words(found) >= F.col(f"{found}.n_words"))


def cut_spans(text: str, first: list[int], last: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    data = text.encode()
    words = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for start, end in zip(first, last, strict=True):
        out.append(data[at : words[start][0]])
        at = words[end][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated; those with hits below the rule lose the merged spans. ``n_chars`` follows the text."""
    found = find_contamination(docs, benchmark, "_found").filter(~is_contaminated("_found"))

    def make(batch: pa.RecordBatch) -> list:
        rows = zip(batch.column("text").to_pylist(), batch.column("_found").to_pylist(), strict=True)
        return [[cut_spans(text, f["first"], f["last"]) if f["first"] else text for text, f in rows]]

    cut = with_struct(found, "_cut", T.StructType([T.StructField("text", T.StringType())]), make)
    changed = {"text": F.col("_cut.text")}
    if "n_chars" in docs.columns:
        length = F.char_length("_cut.text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.size("_found.first") == 0, F.col("n_chars")).otherwise(length)
    return cut.withColumns(changed).select(docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        hit_words("found").alias("n_hit"),
        F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        is_contaminated("found").alias("contaminated"),
        F.array_join(F.zip_with("found.first", "found.last", lambda a, b: F.concat_ws("-", a, b)), ",").alias("spans"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = f"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS pos FROM items WHERE len(w) > 0)),
docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
grams AS (
  SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos
        FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
found AS MATERIALIZED (SELECT doc_id, item_id, pos, size FROM grams JOIN windows USING (size, gram)),
hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM found) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY 1),
islands AS (
  SELECT doc_id, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS island, place - 1 AS place
  FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS place FROM found)),
merged AS (
  SELECT doc_id, string_agg(first_word || '-' || last_word, ',' ORDER BY first_word) AS spans
  FROM (SELECT doc_id, min(place) AS first_word, max(place) AS last_word FROM islands GROUP BY doc_id, island) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(spans, '') AS spans
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN merged USING (doc_id)"""
