"""A corpus from language identification to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next stage's
documents. All stages but the last return the columns of documents. Rows without key or text, empty tables and extra
columns go through each stage as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import decontaminate, language_id, ngram_join, packing, secret_scan
from quotemill.llm.common import remainder_is, settled, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the models reject go."""
    models = language_id.fit(docs.filter(~remainder_is("doc_id", 3, 1)))
    return language_id.identify(docs, models, into="_language").filter("not _language.rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the benchmark passages they may hold."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]

#: The language models, random-string models and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
