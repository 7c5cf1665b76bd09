"""Quality rules: fixed counts of words and lines, and a ratio of hashed n-gram multinomials, in DataFrame functions alone.

Words and pairs of words fall into a fixed number of cells by hash. Over all documents, and over trusted ones, the cells
give two smoothed multinomials. A document's score is the mean log ratio of its n-grams' cells, trusted over raw. Trusted
documents vary in it, the more the shorter they are, and the threshold lies ``tolerance`` standard deviations below their
mean at the document's length, so that every document gets the same verdict in every run.

Null and empty texts have no words and fail the rules. Whole texts are counted, however long. Each row is judged alone, so
repeated rows get equal results. Without trusted documents the ratio is 0 and the rules decide alone; an empty table gives
an empty one; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, table

CELLS = 1 << 14
TOLERANCE = 6.0
LEAST_WORDS = 50
SPACE = " \t\n\x0b\f\r"


def with_words(docs: DataFrame) -> DataFrame:
    """doc_id, the text (null: empty) and its words."""
    text = F.coalesce("text", F.lit(""))
    solid = F.btrim(text, F.lit(SPACE))
    words = F.when(solid != "", F.split(solid, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", text.alias("text"), words.alias("words"))


def cell(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(CELLS)).cast("int")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, even where the optimiser puts its expression in the place of its name."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def with_cells(words: DataFrame) -> DataFrame:
    """Adds the cells of the words and of the pairs of neighbours."""

    def cells(own: Column) -> Column:
        pairs = F.transform(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), lambda w, i: cell(F.get(own, i), w))
        return F.concat(F.transform(own, lambda w: cell(w)), pairs)

    return words.withColumn("cells", bound(F.col("words"), cells))


def cell_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """For each cell its number in all documents and in trusted ones."""
    cells = with_cells(with_words(docs)).select("doc_id", "cells")
    marked = cells.join(trusted.withColumn("trusted", F.lit(True)), "doc_id", "left")
    each = marked.select("trusted", F.explode_outer("cells").alias("cell"))  # explode would make Spark compute the cells once more, for a filter
    return each.groupBy("cell").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target")).filter("cell is not null")


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """For each cell the log of its share in the trusted documents over that in all, with one added to each count."""
    counted = cell_counts(docs, trusted).collect()  # CELLS rows at most
    raw, target = [1] * CELLS, [1] * CELLS
    for row in counted:
        raw[row["cell"]] += row["raw"]
        target[row["cell"]] += row["target"]
    all_raw, all_target = sum(raw), sum(target)
    if all_target == CELLS:
        return [0.0] * CELLS
    return [math.log(t / all_target) - math.log(r / all_raw) for r, t in zip(raw, target, strict=True)]


def scored(words: DataFrame, ratios: list[float]) -> DataFrame:
    """Adds the number of n-grams, their mean log ratio, and the mean square."""
    known = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one constant
    values = with_cells(words).withColumn("values", F.transform("cells", lambda c: F.get(known, c)))
    total = lambda f: F.aggregate("values", F.lit(0.0), lambda x, v: x + f(v))
    n = F.size("values")
    return values.withColumns({"n_grams": n, "ratio": F.coalesce(F.try_divide(total(lambda v: v), n), F.lit(0.0))})


def usual(words: DataFrame, ratios: list[float]) -> tuple[float, float, float]:
    """Of trusted documents the mean score, its variance between them, and that within one."""
    own = scored(words, ratios).withColumn("ratio", F.when(F.col("n_grams") > 0, F.col("ratio")))
    square = F.aggregate("values", F.lit(0.0), lambda x, v: x + v * v) / F.nullif("n_grams", F.lit(0))
    within = square - F.col("ratio") ** 2
    row = own.agg(F.avg("ratio"), F.var_pop("ratio") - F.avg(within / F.nullif("n_grams", F.lit(0))), F.avg(within)).first()
    return (0.0, math.inf, 0.0) if row[0] is None else (row[0], max(row[1], 1e-4), row[2])


def counts(words: DataFrame) -> DataFrame:
    """The contract's counts. Windows of three words are compared by 64-bit hashes within a document."""
    n = F.size("words")
    window = bound(
        F.col("words"),
        lambda own: F.transform(
            F.slice(own, 1, F.greatest(F.size(own) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(own, i + 1), F.get(own, i + 2))
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    first = words.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint"),
            "windows": window,
            "lines": lines,
        }
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    second = first.withColumns({"n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"), "placed": placed})

    def starts(own: Column) -> Column:
        """Where the windows begin that occur twice or more."""
        same = lambda x, i: F.get(own, i)["h"].eqNullSafe(x["h"])
        return F.sort_array(F.transform(F.filter(own, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

    def covered(own: Column) -> Column:
        """Words in those windows: three each, less where the one before reaches."""
        each = F.transform(own, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(own, i - 1), F.lit(-3))))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda x, v: x + v)

    third = second.withColumn("starts", bound(F.col("placed"), starts))
    sum_of = bound(F.col("starts"), covered)
    return third.withColumn("n_repeat_words", F.coalesce(sum_of, F.lit(0).cast("bigint"))).drop("windows", "lines", "placed", "starts")


def judge(docs: DataFrame, trusted: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """The counts, whether the fixed rules fail, the n-gram score, and whether the document is kept.

    ``trusted`` holds the doc_ids of trusted documents, in any number.
    """
    own = docs.select("doc_id", "text")
    trusted = beside(trusted.filter("doc_id is not null").distinct())
    ratios = log_ratios(own, trusted)
    mean, between, within = usual(with_words(own.join(trusted, "doc_id", "left_semi")), ratios)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts(scored(with_words(own), ratios)).withColumn("base_failed", failed)
    threshold = mean - tolerance * F.sqrt(F.lit(between) + F.lit(within) / F.greatest("n_grams", F.lit(1)))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(*names, (~F.col("base_failed") & (F.col("ratio") >= threshold)).alias("kept"), "ratio")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return judge(table(spark, sf_dir, "documents"), labels.filter("quality = 1").select("doc_id"))
