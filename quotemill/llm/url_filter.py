"""URL filters: allow and block rules, and a ratio of character models for the urls that no rule fits.

Two variable-order Markov models, of urls that rules allow and of urls that they block, give each character a probability
from the longest context seen, with Witten-Bell smoothing down to the shorter ones. A url without a rule is blocked where
the log-likelihood difference per character lies above a threshold, chosen on urls held out of the training for the
fewest errors.

Every distinct url with a rule counts. Counts are additive, so tasks and shuffles sum them, by kind, context and character;
what reaches the driver and the tasks is a table with a fixed number of cells (``GRAM_BITS``, ``CONTEXT_BITS``), where counts
whose hashes meet are added up. The threshold comes from histograms of the held-out ratios with bins of fixed width.

A null url, or one without ``://``, has empty host and path and no rule; the models judge its characters, and an empty
text is allowed. Urls are read whole. Ties of the ratio with the threshold are allowed. Each row is judged alone, so
repeated rows get equal results; without urls of one kind the models allow everything; an empty table gives an empty
one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps, table, texts, with_struct

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 5
KINDS = ("allow", "block")
#: Bits of the numbers of cells for characters after contexts, and for contexts: 48 MB for both models.
GRAM_BITS, CONTEXT_BITS = 21, 21
#: One url in so many is held out of the training; with fewer urls of a kind than FEW all of them choose the threshold too.
HELD, FEW = 5, 50
#: Width of a histogram's bins in nats per character, and the ratio that the outermost ones begin at.
BIN, WIDEST = 1 / 256, 16
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("verdict", T.StringType())])


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)  # empty without the mark
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null without one. Equal lengths go by text."""
    rule = verdict = F.lit(None).cast("string")
    for of, start, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):  # the longest is asked first
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def cells(keys: np.ndarray, bits: int) -> np.ndarray:
    """Cells of whole numbers, by multiplicative hashing."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def contexts(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """All characters of the urls, the url of each, and by order the characters with so long a context and its exact number."""
    char = np.frombuffer(b"".join(urls), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, urls), np.int64, len(urls))
    of = np.repeat(np.arange(len(urls)), size)
    place = np.arange(len(char)) - np.repeat(np.cumsum(size) - size, size)

    def by_order() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        before = np.zeros(len(char), np.int64)
        for order in range(ORDER + 1):
            if order:
                before[order:] += char[:-order] << 8 * (order - 1)
            at = np.flatnonzero(place >= order)
            yield at, before[at] | order << 8 * ORDER

    return char, of, by_order()


class UrlRatio:
    """Both models as tables of cells: counts of characters after contexts, of contexts, and of the kinds of characters after them."""

    def __init__(self, gram_bits: int = GRAM_BITS, context_bits: int = CONTEXT_BITS):
        self.bits = gram_bits, context_bits
        self.grams = np.zeros((2, 1 << gram_bits), np.float32)
        self.totals, self.kinds = np.zeros((2, 2, 1 << context_bits), np.float32)
        self.threshold = np.inf

    def __getstate__(self) -> dict:
        """For the way to the tasks, only the cells that hold something."""
        state = dict(self.__dict__)
        for name in ("grams", "totals", "kinds"):
            flat = state[name].ravel()
            at = np.flatnonzero(flat).astype(np.int32)
            state[name] = at, flat[at], state[name].shape
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        for name in ("grams", "totals", "kinds"):
            at, values, shape = state[name]
            table_ = np.zeros(shape, np.float32)
            table_.ravel()[at] = values
            setattr(self, name, table_)

    def ratios(self, urls: list[bytes]) -> np.ndarray:
        """How much better the model of blocked urls explains each one, in nats per character."""
        char, of, by_order = contexts(urls)
        chance, seen = np.full((2, len(char)), 1 / 256), np.ones((2, len(char)), bool)
        for at, context in by_order:
            cell, gram = cells(context, self.bits[1]), cells(context << 8 | char[at], self.bits[0])
            for model in range(2):
                total = self.totals[model][cell].astype(np.float64)
                seen[model, at] &= total > 0
                met = seen[model, at]
                own, kinds = at[met], self.kinds[model][cell[met]]
                chance[model, own] = (np.minimum(self.grams[model][gram[met]], total[met]) + kinds * chance[model, own]) / (total[met] + kinds)
        nats = np.log(chance[1] / chance[0])
        size = np.bincount(of, minlength=len(urls))
        return np.bincount(of, nats, len(urls)) / np.maximum(1, size)

    def ratio(self, url: bytes) -> float:
        return float(self.ratios([url])[0])


def fewest_errors(allowed: np.ndarray, blocked: np.ndarray, edges: np.ndarray) -> float:
    """The edge with the lowest sum of both error rates, the middle one of equals; counts are of ratios up to each edge."""
    errors = 1 - allowed / allowed[-1] + blocked / blocked[-1]
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(edges[best[len(best) // 2]])


def judged(pages: DataFrame, url: str = "url") -> DataFrame:
    """The rows with host, path, rule and the rule's verdict."""
    host, path = host_and_path(F.col(url))
    parts = pages.withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"))
    return parts.withColumns({"rule": rule, "rule_verdict": verdict})


def fit(pages: DataFrame, gram_bits: int = GRAM_BITS, context_bits: int = CONTEXT_BITS) -> UrlRatio:
    """Models and threshold from all distinct urls with rules."""
    held = F.crc32("url") % HELD == 0
    known = judged(pages.select("url")).filter("rule_verdict is not null")
    known = known.select("url", (F.col("rule_verdict") == KINDS[1]).cast("int").alias("kind"), held.alias("held")).distinct()
    model = UrlRatio(gram_bits, context_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "url"):
                urls, kind = [url.encode() for url in texts(part, "url")], part.column("kind").to_numpy()
                char, of, by_order = contexts(urls)
                for at, context in by_order:
                    keys, n = np.unique((context << 8 | char[at]) << 1 | kind[of[at]], return_counts=True)
                    columns = [pa.array((keys & 1).astype(np.int32)), pa.array(keys >> 1), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "gram", "n"])

    grams = known.filter(~held).select("url", "kind").mapInArrow(count, "kind int, gram bigint, n bigint")
    grams = grams.groupBy("kind", "gram").agg(F.sum("n").alias("n"))
    own = grams.groupBy("kind", F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))

    def celled(rows: DataFrame, key: str, bits: int, *sums: str) -> pa.Table:
        """Sums by cell: as many rows as there are cells, at most."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = pa.array(cells(batch.column(key).to_numpy(), bits))
                yield pa.RecordBatch.from_arrays([batch.column("kind"), cell, *(batch.column(x) for x in sums)], ["kind", "cell", *sums])

        schema = "kind int, cell bigint, " + ", ".join(f"{x} bigint" for x in sums)
        return rows.mapInArrow(run, schema).groupBy("kind", "cell").agg(*[F.sum(x).alias(x) for x in sums]).toArrow()

    at = celled(grams, "gram", gram_bits, "n")
    model.grams[at.column("kind").to_numpy(), at.column("cell").to_numpy()] = at.column("n").to_numpy()
    at = celled(own, "context", context_bits, "n", "kinds")
    for target, name in ((model.totals, "n"), (model.kinds, "kinds")):
        target[at.column("kind").to_numpy(), at.column("cell").to_numpy()] = at.column(name).to_numpy()

    sizes = {row.kind: row.n for row in known.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    few = [kind for kind, n in sizes.items() if n < FEW]
    number = 2 * int(WIDEST / BIN)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "url"):
                ratio = shared.value.ratios([url.encode() for url in texts(part, "url")])
                cell = np.clip(np.ceil((ratio + WIDEST) / BIN), 0, number).astype(np.int32)  # the first edge not below it
                yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array(cell)], ["kind", "cell"])

    judge_by = known.filter(held | F.col("kind").isin(few)).select("url", "kind")
    found = np.zeros((2, number + 1), np.int64)
    for row in judge_by.mapInArrow(measure, "kind int, cell int").groupBy("kind", "cell").agg(F.count("*").alias("n")).collect():
        found[row.kind, row.cell] = row.n
    shared.destroy()
    edges = np.arange(number + 1) * BIN - WIDEST
    model.threshold = fewest_errors(*found.cumsum(axis=1), edges) if found.any(axis=1).all() else 0.0
    return model


def judge(pages: DataFrame, model: UrlRatio) -> DataFrame:
    """(page_id, host, path, rule, verdict, ratio) for every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        ratios = shared.value.ratios([url.encode() for url in texts(batch, "url")])
        return [ratios, np.where(ratios > shared.value.threshold, KINDS[1], KINDS[0])]

    scored = with_struct(pages.select("page_id", "url"), "model", FIELDS, make, column="url")
    verdict = F.coalesce("rule_verdict", "model.verdict").alias("verdict")
    return judged(scored).select("page_id", "host", "path", "rule", verdict, F.col("model.ratio").alias("ratio"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(pages))
