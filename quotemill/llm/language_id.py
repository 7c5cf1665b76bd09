"""Language identification: interpolated Kneser-Ney models of characters, one per language, in sorted arrays of hashes.

Texts become runs of lower-case letters with single spaces. The models have four orders. Counts of four characters are
summed by Spark over a bounded, deterministic sample of labelled rows; the lower orders' continuation counts, discounts
and back-off weights follow from them. A text gets the language with the lowest cross-entropy per character. It is
rejected where that lies further above what is usual for the language, at the text's length, than so many standard
deviations that of the language's own texts at most the share REJECTED is expected to be. The usual values come from the
sample; the number of deviations from a second sample, which the models have not learnt and which shares no text with the
first: it is the least bound that the conformal rule gives for that share. Where the second sample is too small for that
(1 / REJECTED rows are needed), the bound is its largest value, and at least FEW_DEVIATIONS.

Null texts and texts without letters are ``und`` with score 0 and rejected. Whole texts are scored; very long ones in
pieces of a million characters, whose sums are added. Ties go to the first language by name. Each row is judged alone,
so repeated rows get equal results, and rows that repeat a doc_id are sampled each for itself. Without labelled rows every text is ``und``; an empty table gives an empty one. Other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import STEP_CHARS, remainder_is, rest, settled, steps, table, texts, with_struct

ORDER = 4
#: Labelled rows of each language that the models are fitted on, about.
ROWS_PER_LANGUAGE = 1500
#: More languages than this raise: counts of all languages come together.
MAX_LANGUAGES = 1000
#: Share of a language's own texts that may be rejected, and the bound where too few rows tell.
REJECTED, FEW_DEVIATIONS = 0.001, 9.0
#: One text in so many is kept from the models, for the bound.
KEPT_APART = 5
#: Bytes of texts whose grams are looked up together: a worker holds some hundred bytes for each.
STEP_BYTES = 500_000
UNKNOWN = "und"
BASE = np.uint64(0x9E3779B97F4A7C15)

FIELDS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("letters", T.LongType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four code points for each character of the folded texts, and the text of each."""
    low = [value.lower() for value in values]
    size = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(low)), size)
    letter = letters()[codes]
    after = np.zeros_like(letter)
    after[1:] = letter[:-1] & (of[1:] == of[:-1])
    keep = letter | after  # of a run without letters one space
    chars, of = np.where(letter, codes, 32)[keep], of[keep]
    padded = np.full(len(chars) + (ORDER - 1) * len(low), 32, np.uint32)
    place = np.arange(len(chars)) + (ORDER - 1) * (of + 1)
    padded[place] = chars
    return np.stack([padded[place - back] for back in range(ORDER - 1, -1, -1)]), of


def hashed(columns: np.ndarray) -> np.ndarray:
    h = np.zeros(columns.shape[1], np.uint64)
    for column in columns:
        h = h * BASE + column.astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def distinct(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams, where each belongs, and how often each occurs."""
    _, index, inverse, number = np.unique(hashed(columns), return_index=True, return_inverse=True, return_counts=True)
    return columns[:, index], inverse, number


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[int]]]:
    """Texts of a slice, with very long ones cut, and the row of each piece."""
    for row, text in enumerate(texts(batch)):
        for at in range(0, len(text), STEP_CHARS):
            yield text[at : at + STEP_CHARS], row


class KneserNey:
    """One language: for each order the sorted hashes and probabilities of its grams, and of its contexts the back-off weights."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray):
        tables = [(columns, counts.astype(np.float64))]
        for _ in range(ORDER - 1):  # of a lower order: how many different characters stand before
            shorter, _, number = distinct(tables[0][0][1:])
            tables.insert(0, (shorter, number.astype(np.float64)))
        self.uniform = 1.0 / (tables[0][0].shape[1] + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for grams_, number in tables:
            ones, twos = (number == 1).sum(), (number == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            contexts, of = np.unique(hashed(grams_[:-1]), return_inverse=True)
            total, kinds = np.bincount(of, number), np.bincount(of)
            weight = discount * kinds / total
            chance = np.maximum(number - discount, 0) / total[of] + weight[of] * self.chance(grams_[1:])
            keys = hashed(grams_)
            order = np.argsort(keys)
            self.levels.append((keys[order], chance[order], contexts, weight))

    def chance(self, columns: np.ndarray) -> np.ndarray:
        """Probability of the last character after the others, by as many orders as there are columns and levels."""
        out = np.full(columns.shape[1], self.uniform)
        for order, (keys, chances, contexts, weights) in enumerate(self.levels[: len(columns)], 1):
            own = columns[len(columns) - order :]
            at, known = find(contexts, hashed(own[:-1]))
            out = np.where(known, weights[at], 1.0) * out
            at, known = find(keys, hashed(own))
            out = np.where(known, chances[at], out)
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class LanguageModels:
    def __init__(self, models: dict[str, KneserNey]):
        self.names = sorted(models)
        self.models = [models[name] for name in self.names]
        self.usual: list[tuple[float, float, float]] = [(0.0, np.inf, np.inf)] * len(self.names)
        self.deviations = [FEW_DEVIATIONS] * len(self.names)

    def entropies(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of each text, and the sums of nats and squared nats by text and language."""
        own = list(pieces(batch))
        shape = (batch.num_rows, len(self.names))
        size, nats, squares = np.zeros(batch.num_rows, np.int64), np.zeros(shape), np.zeros(shape)
        if own:
            columns, of = grams([text for text, _ in own])
            row = np.array([row for _, row in own])[of]
            size += np.bincount(row, minlength=batch.num_rows)
            kinds, which, _ = distinct(columns)
            for i, model in enumerate(self.models):
                cost = -np.log(model.chance(kinds))
                nats[:, i] = np.bincount(row, cost[which], batch.num_rows)
                squares[:, i] = np.bincount(row, (cost**2)[which], batch.num_rows)
        return size, nats, squares

    def identify(self, batch: pa.RecordBatch, tolerance: float | None) -> list:
        size, nats, _ = self.entropies(batch)
        n = np.maximum(size, 1)
        rate = nats / n[:, None]
        known = (size > 0) & bool(self.names)
        best = rate.argmin(axis=1) if self.names else np.zeros(len(n), np.int64)
        low = rate[np.arange(len(n)), best] if self.names else np.zeros(len(n))
        # Characters of a text are not independent, so a long text counts as fifty.
        odds = np.exp(-(rate - low[:, None]) * np.minimum(n, 50)[:, None])
        score = np.where(known, 1 / np.maximum(odds.sum(axis=1), 1), 0.0)
        mean, between, within = (np.array(x)[best] for x in zip(*self.usual, strict=True)) if self.names else (low, low, low)
        most = np.array(self.deviations)[best] if tolerance is None and self.names else tolerance or 0.0
        rejected = ~known | (low > mean + most * np.sqrt(between + within / n))
        names = [self.names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return [names, score, np.where(known, low, np.nan), size, rejected]


def labelled_sample(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows of each language for the models and as many with ``apart`` for the bound: those with the smallest hashes.

    Equal texts are on the same side.
    """
    some = docs.filter("lang is not null and text is not null").withColumn("apart", F.pmod(F.xxhash64("text"), F.lit(KEPT_APART)) == 0)
    sizes = some.groupBy("lang", "apart").count().limit(2 * MAX_LANGUAGES + 2).collect()
    if len({row["lang"] for row in sizes}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return some.limit(0)
    share = F.lit(0.0)
    for row in sizes:
        share = F.when((F.col("lang") == row["lang"]) & (F.col("apart") == row["apart"]), float(rows) / row["count"]).otherwise(share)
    return some.filter(F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(1 << 30)) < share * (1 << 30))


def bound(deviations: list[float]) -> float:
    """Deviations that a further text of the language exceeds with the chance REJECTED at most, after those of the given ones, in order."""
    at = int(np.ceil((len(deviations) + 1) * (1 - REJECTED) - 1e-9))
    return deviations[at - 1] if 0 < at <= len(deviations) else max([FEW_DEVIATIONS, *deviations[-1:]])


def fit(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> LanguageModels:
    """Models of the languages that label the rows (doc_id, text, lang)."""
    both = labelled_sample(docs.select("doc_id", "text", "lang"), rows)
    sample = both.filter("not apart")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                own, langs = list(pieces(part)), part.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    columns, _ = grams([text for text, row in own if langs[row] == lang])
                    kinds, _, number = distinct(columns)
                    pairs = kinds.astype(np.int64)
                    arrays = [(pairs[0] << 21) | pairs[1], (pairs[2] << 21) | pairs[3], number]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(number)), *map(pa.array, arrays)], ["lang", "head", "tail", "n"])
        rest()

    counted = sample.mapInArrow(count, "lang string, head bigint, tail bigint, n bigint")
    counts = counted.groupBy("lang", "head", "tail").agg(F.sum("n").alias("n")).orderBy("lang", "head", "tail").toArrow()
    langs = counts.column("lang").to_numpy()
    head, tail, n = (counts.column(x).to_numpy() for x in ("head", "tail", "n"))
    low = (1 << 21) - 1
    columns = np.stack([head >> 21, head & low, tail >> 21, tail & low]).astype(np.uint32)
    models = LanguageModels({lang: KneserNey(columns[:, langs == lang], n[langs == lang]) for lang in np.unique(langs)})
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP_BYTES):
                size, nats, squares = shared.value.entropies(part)
                own = np.searchsorted(np.array(models.names), np.array(part.column("lang").to_pylist(), object).astype(str))
                own = np.minimum(own, len(models.names) - 1)
                rows_ = np.arange(len(own))
                known = np.array(models.names)[own] == np.array(part.column("lang").to_pylist(), object).astype(str)
                arrays = [np.where(known, size, 0), nats[rows_, own], squares[rows_, own]]  # a language may lie apart alone
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("lang", "apart")), *map(pa.array, arrays)], names)
        rest()

    names = ["lang", "apart", "size", "nats", "squares"]
    if models.names:
        schema = "lang string, apart boolean, size bigint, nats double, squares double"
        measured = settled(both.mapInArrow(measure, schema).filter("size > 0"), "entropies")  # three numbers for each row of both samples
        rate = F.col("nats") / F.col("size")
        usual = measured.filter("not apart").groupBy("lang").agg(
            F.avg(rate).alias("mean"),
            F.avg(F.col("squares") / F.col("size") - rate**2).alias("within"),
            # between texts, less what their lengths account for
            F.greatest(F.var_pop(rate) - F.avg((F.col("squares") / F.col("size") - rate**2) / F.col("size")), F.lit(0.01)).alias("between"),
        )
        by = {row["lang"]: (row["mean"], row["between"], row["within"]) for row in usual.collect()}
        models.usual = [by.get(name, (0.0, np.inf, np.inf)) for name in models.names]
        above = (rate - F.col("mean")) / F.sqrt(F.col("between") + F.col("within") / F.col("size"))
        apart = measured.filter("apart").join(usual, "lang").groupBy("lang").agg(F.sort_array(F.collect_list(above)).alias("above"))
        found = {row["lang"]: bound(row["above"]) for row in apart.collect()}  # ``rows`` numbers for each language, about
        models.deviations = [found.get(name, FEW_DEVIATIONS) for name in models.names]
    return models


def identify(docs: DataFrame, models: LanguageModels, into: str = "language", tolerance: float | None = None) -> DataFrame:
    """The rows with a struct of lang, score, cross-entropy in nats, letters, and whether the text is rejected.

    ``tolerance``: deviations beyond which texts are rejected, instead of the calibrated ones.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return with_struct(docs, into, FIELDS, lambda batch: shared.value.identify(batch, tolerance), size=STEP_BYTES)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.filter(~remainder_is("doc_id", 3, 1)))
    return identify(docs.select("doc_id", "text"), models).select(
        "doc_id",
        remainder_is("doc_id", 3, 1).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.cross_entropy").alias("cross_entropy"),
        F.col("language.rejected").alias("rejected"),
    )
