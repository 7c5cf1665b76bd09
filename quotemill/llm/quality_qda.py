"""Quality classifier: regularised quadratic discriminant analysis over statistics of the text.

Each class has a mean and a covariance of transformed statistics; covariances are shrunk toward the pooled one and that
toward its diagonal. Their Cholesky factors are computed once and shared, so a score is a difference of Mahalanobis
distances and log determinants, by one triangular product per class, turned into a probability.

Null and empty texts have all-zero statistics and get the score of those. Texts are read whole. Each row is judged alone,
so repeated rows get equal results and ties cannot matter; repeated labels of a document count once each. Without labels
of one class the score is the share of the other; an empty table gives an empty one. Other columns play no part.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_ids, remainder_is, table, texts, with_struct

#: Labelled documents that the classifier is fitted on, at most.
TRAINING_ROWS = 10_000
TOWARD_POOLED = 0.3
TOWARD_DIAGONAL = 0.1
FLOOR = 1e-3

STATISTICS = (
    "words",
    "word length",
    "long words",
    "upper case",
    "digits",
    "symbols",
    "exclamation",
    "other marks",
    "words with marks inside",
    "distinct words",
    "commonest word",
    "repeated neighbours",
    "repeated lines",
    "lone marks",
    "sentence ends",
)

_KIND = np.zeros(256, np.int8)  # upper, lower (and all beyond ASCII), digit, symbol, exclamation, sentence end, other mark, space
_KIND[:] = 6
_KIND[[*range(9, 14), 32]] = 7
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 1, 2
_KIND[list(b"#*$%&|<>")] = 3
_KIND[list(b"!")] = 4
_KIND[list(b".,?")] = 5


def statistics(text: str) -> list[float]:
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    kind = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8).tolist()
    n, solid = len(words), max(1, sum(kind[:7]))
    letters = max(1, kind[0] + kind[1])
    count = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    root = np.sqrt
    return [
        np.log1p(n),
        np.log(solid / n),
        root(sum(c for w, c in count.items() if len(w) > 20) / n),
        root(kind[0] / letters),
        root(kind[2] / solid),
        root(kind[3] / solid),
        root(kind[4] / solid),
        root(kind[6] / solid),
        root(sum(c for w, c in count.items() if not w[-1:].isalnum() and w[-1] < 128) / n),
        np.log1p(len(count)) / np.log1p(n),
        root(max(count.values()) / n),
        root(sum(map(bytes.__eq__, words, words[1:])) / n),
        root((len(lines) - len(set(lines))) / max(1, len(lines))),
        root(sum(c for w, c in count.items() if len(w) == 1 and not w.isalnum()) / n),
        root(kind[5] / n),
    ]


class Discriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.share = float(y.mean()) if len(y) else 0.5
        self.one_sided = len(y) == 0 or self.share in (0.0, 1.0)
        if self.one_sided:
            return
        self.center, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        x = (x - self.center) / self.scale
        groups = [x[y == k] for k in (0, 1)]
        self.means = [g.mean(axis=0) for g in groups]
        own = [np.cov(g.T, bias=True) for g in groups]
        pooled = (1 - self.share) * own[0] + self.share * own[1]
        self.factors, self.constants = [], []
        for k, cov in enumerate(own):
            cov = (1 - TOWARD_POOLED) * cov + TOWARD_POOLED * pooled
            cov = (1 - TOWARD_DIAGONAL) * cov + TOWARD_DIAGONAL * np.diag(np.diag(cov)) + FLOOR * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(factor))
            self.constants.append(np.log(self.share if k else 1 - self.share) - np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        if self.one_sided:
            return np.full(len(x), self.share)
        x = (x - self.center) / self.scale
        logs = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -600, 600) / self.temperature))

    #: Statistics are far from normal, so odds are flattened; the order of scores and the side of one half stay.
    temperature = 4.0


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Discriminant:
    """From labels (doc_id, quality) of at most ``rows`` documents (doc_id, text)."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality in (0, 1)")
    ids = bounded_ids(own, "doc_id", rows)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    found = _described(some).select("doc_id", "x.x").join(own, "doc_id").orderBy("doc_id", "quality", "x").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
    return Discriminant(x, found.column("quality").to_numpy())


def _described(docs: DataFrame) -> DataFrame:
    fields = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    return with_struct(docs, "x", fields, lambda batch: [[statistics(text) for text in texts(batch)]])


def classify(docs: DataFrame, model: Discriminant, into: str = "quality") -> DataFrame:
    """The rows with a struct of the score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        return [shared.value.score(np.array([statistics(text) for text in texts(batch)]))]

    return with_struct(docs, into, T.StructType([T.StructField("score", T.DoubleType())]), make)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = ~remainder_is("doc_id", 3, 1)
    model = fit(docs.filter(learn), table(spark, sf_dir, "labels").filter(learn))
    score = F.col("quality.score")
    return classify(docs, model).select(
        "doc_id", remainder_is("doc_id", 3, 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )
