"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two character models of second order, with additive smoothing, are trained from labelled samples: random strings and
identifiers. A run of secret-like characters counts as a secret where the log-likelihood ratio per character is above
the threshold that separates the samples best.

Null and empty texts have no spans. Texts are scanned whole, whatever their length. Each row is judged alone, so
repeated rows get equal results, an empty table gives an empty one, and other columns play no part.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, texts, with_struct

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")
LEAST_RUN = 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Parts of ordinary identifiers; the labelled sample joins them in the usual ways.
PARTS = (
    "account action address agent amount article backup balance batch border branch buffer button cache category change channel"
    " client cluster column comment commit common config connection content context control counter country current customer data"
    " database default delete description device digest document download driver element email encoding engine error event example"
    " executor expected export factory feature filter folder format function gateway group handler header history identifier image"
    " import index information input instance interface internal invoice iterator language latest layout length library limit link"
    " listener location logger manager market maximum member memory message method minimum model module monitor network notification"
    " number object operation option order output package parameter parser partition password pattern payment performance permission"
    " pipeline platform policy position previous process product profile project property protocol provider public query queue reader"
    " record reference region register remote report request resource response result return sample schedule schema search section"
    " security selection sequence server service session setting signature simple source statement station statistics status storage"
    " stream string structure subscription summary support system table target template temporary test thread timestamp title token"
    " total training transaction transfer translation update upload user validation value variable version view warehouse window"
    " worker workspace writer gewerkschaft verwaltung entwicklung geschwindigkeit regierung gesellschaft einrichtung versicherung"
    " developpement gouvernement etablissement administration naturellement informacion responsabilidad desarrollo conocimiento"
).split()

FIELDS = T.StructType(
    [
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("kinds", T.ArrayType(T.StringType())),
        T.StructField("base_sha256", T.StringType()),
    ]
)


def labelled_samples(per_kind: int = 400, seed: int = 7) -> list[tuple[str, int]]:
    """Random strings of the usual alphabets (label 1) and ordinary identifiers, paths and words (label 0)."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")
    samples = []
    for alphabet in alphabets:
        samples += [("".join(rng.choices(alphabet, k=rng.randint(20, 64))), 1) for _ in range(per_kind)]
    joins = (
        lambda p: "_".join(p),
        lambda p: "-".join(p),
        lambda p: "/".join(p),
        lambda p: "".join(p),
        lambda p: p[0] + "".join(x.title() for x in p[1:]),
        lambda p: "".join(x.title() for x in p),
        lambda p: "_".join(p).upper(),
        lambda p: "".join(p).upper(),
        lambda p: "/".join(p) + f"-{rng.randint(1, 31):02}-{rng.randint(1990, 2035)}",
        lambda p: "_".join(p) + f"_{rng.randint(0, 9999)}",
    )
    for join in joins:
        samples += [(join(rng.choices(PARTS, k=rng.randint(3, 6))), 0) for _ in range(per_kind)]
    for char in "=-_/+":
        samples += [(char * rng.randint(20, 80), 0) for _ in range(per_kind // 20)]
    samples += [(str(rng.randint(0, 9)) * rng.randint(20, 40), 0) for _ in range(per_kind // 20)]
    return samples


class MarkovRatio:
    """Log-likelihood ratio per character of two second-order character models."""

    def __init__(self, samples: list[tuple[str, int]], smoothing: float = 0.05):
        size = len(ALPHABET) + 1
        self.code = np.zeros(128, np.int64)
        for i, char in enumerate(ALPHABET):
            self.code[ord(char)] = i + 1
        counts = np.full((2, size, size, size), smoothing)
        for text, label in samples:
            a, b, c = self.grams(text)
            np.add.at(counts[label], (a, b, c), 1)
        lower = counts.sum(axis=1)  # the last two characters
        lower /= lower.sum(axis=-1, keepdims=True)
        strength = 4.0
        model = (counts - smoothing + strength * lower[:, None]) / ((counts - smoothing).sum(axis=-1, keepdims=True) + strength)
        self.ratio = np.log(model[1]) - np.log(model[0])
        scored = sorted((self.score(text), label) for text, label in samples)
        labels = np.array([label for _, label in scored])
        wrong = np.cumsum(labels) + (labels == 0).sum() - np.cumsum(labels == 0)  # if all up to here are ordinary
        best = int(np.argmin(wrong))
        self.threshold = (scored[best][0] + scored[min(best + 1, len(scored) - 1)][0]) / 2

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = np.r_[0, 0, self.code[np.frombuffer(text.encode("ascii"), np.uint8)]]
        return codes[:-2], codes[1:-1], codes[2:]

    def score(self, text: str) -> float:
        return float(self.ratio[self.grams(text)].mean())

    def is_random(self, text: str) -> bool:
        return self.score(text) > self.threshold


@lru_cache(maxsize=1)
def trained() -> MarkovRatio:
    """The models of the default samples; a second of work, once per process."""
    return MarkovRatio(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and then kind as listed."""
    found = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if max(map(len, text.split()), default=0) >= LEAST_RUN:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return [(start, end, KINDS[kind]) for start, kind, end in sorted(found)]


def scan(text: str, model: MarkovRatio) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans with the model's: long runs, or what base spans leave of them, that look random."""
    base = base_spans(text)
    spans = list(base)
    if max(map(len, text.split()), default=0) >= LEAST_RUN:
        starts, ends = [span[0] for span in base], list(accumulate((span[1] for span in base), max))
        for m in RUN.finditer(text):
            if m.end() - m.start() >= LEAST_RUN:
                at = m.start()
                cuts = range(bisect_right(ends, at), bisect_left(starts, m.end()))  # base spans that end in the run or behind it
                for start, end in [*((starts[i], ends[i]) for i in cuts), (m.end(), m.end())]:
                    if start - at >= LEAST_RUN and model.is_random(text[at:start]):
                        spans.append((at, start, "model"))
                    at = max(at, end)
    return base, sorted(spans, key=lambda span: (span[0], KINDS.index(span[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _make(batch: pa.RecordBatch) -> list:
    model = trained()
    starts, ends, kinds, digests = [], [], [], []
    for text in texts(batch):
        base, spans = scan(text, model)
        starts.append([span[0] for span in spans])
        ends.append([span[1] for span in spans])
        kinds.append([span[2] for span in spans])
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
    return [starts, ends, kinds, digests]


def find_secrets(docs: DataFrame, into: str = "secrets") -> DataFrame:
    """The rows with a struct of span starts, ends (exclusive, code points), kinds, and the digest of the base spans."""
    return with_struct(docs, into, FIELDS, _make)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows with each run of touching or overlapping spans replaced by a mark; ``n_chars``, where there is one, follows the text."""
    fields = T.StructType([T.StructField("text", T.StringType())])

    def make(batch: pa.RecordBatch) -> list:
        model = trained()
        out = []
        for text in batch.column("text").to_pylist():
            pieces, at = [], 0
            for start, end, _ in scan(text, model)[1] if text else ():
                if start > at or not pieces:
                    pieces += [text[at:start], mark]
                at = max(at, end)
            out.append("".join([*pieces, text[at:]]) if pieces else text)
        return [out]

    clean = with_struct(docs, "_redacted", fields, make)
    changed = {"text": F.col("_redacted.text")}
    if "n_chars" in docs.columns:
        same = F.col("_redacted.text").eqNullSafe(F.col("text"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.char_length("_redacted.text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumns(changed).select(docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets.kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    span = lambda k, i: F.concat_ws(":", k, F.element_at("secrets.starts", i + 1), F.element_at("secrets.ends", i + 1))
    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS[:3]),
        F.col("secrets.base_sha256").alias("base_sha256"),
        F.array_join(F.transform("secrets.kinds", span), ",").alias("spans"),
        count("model"),
    )
