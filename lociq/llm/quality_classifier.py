"""Quality classifier: regularised quadratic discriminant over statistics of the text."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.common import fold, texts_of
from lociq.scratch import stored

FOLDS = 5
THRESHOLD = 0.3
#: Shares are moved off zero by this much before their logarithm is taken.
_LEAST = 1e-3
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbols": b"#*$%&<>@\\^_~{}[]=+", "bars": b"|", "shouts": b"!?", "digits": b"0123456789", "stops": b".,;:"}
_OF_BYTE = np.array([[b in chars for chars in _CLASSES.values()] for b in range(256)], dtype=np.int64)
FEATURES = ("words", "word_bytes", *_CLASSES, "distinct", "repeats", "same_lines", "line_words")


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes and of shares."""
    words = text.split()
    n, letters = len(words), max(1, sum(map(len, words)))
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _OF_BYTE / letters
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(map(operator.eq, words, words[1:])) / max(1, n)
    same = 1 - len(set(lines)) / max(1, len(lines))
    distinct = len(set(words)) / max(1, n)
    return [
        np.log1p(n),
        np.log(letters / max(1, n)),
        *np.log(shares + _LEAST),
        distinct,
        np.log(repeats + _LEAST),
        np.log(same + _LEAST),
        np.log1p(n / max(1, len(lines))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and one double for each of FEATURES. Null texts are empty; every row gives one row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t) for t in texts_of(batch)], dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in rows.T]], names=["doc_id", *FEATURES])

    schema = ", ".join(["doc_id long", *[f"{x} double" for x in FEATURES]])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(measure, schema)


@dataclass
class Discriminant:
    """For each class: log prior and half log determinant, mean, and the inverse of the covariance's Cholesky
    factor, over features scaled to unit pooled variance. Empty if a class had no rows: then every score is
    ``constant``."""

    scale: np.ndarray
    parts: list[tuple[float, np.ndarray, np.ndarray]]
    constant: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:
            return np.full(len(x), self.constant)
        x = x / self.scale
        density = [base - 0.5 * np.square((x - mean) @ inverse.T).sum(axis=1) for base, mean, inverse in self.parts]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit(rows: DataFrame, label: str, to_pooled: float = 0.8, to_round: float = 0.05) -> Discriminant:
    """Fit on all rows that have a label of 0 or 1; one aggregation gives the classes' moments.

    Each class covariance is drawn to the pooled one by ``to_pooled`` and then to a multiple of the identity by
    ``to_round``, so that features that hardly vary within a class cannot decide alone.
    """
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(F.col(x)) for x in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]
    found = {r[0]: r for r in rows.filter(F.col(label).isin(0, 1)).groupBy(label).agg(F.count("*"), *sums).collect()}
    k = len(FEATURES)
    if len(found) < 2:
        return Discriminant(np.ones(k), [], 0.5 if not found else float(next(iter(found))))
    counts, means, spreads = [], [], []
    for c in (0, 1):
        n, total, cross = found[c][1], np.array(found[c][2 : 2 + k]), np.zeros((k, k))
        for (i, j), v in zip(pairs, found[c][2 + k :], strict=True):
            cross[i, j] = cross[j, i] = v
        counts.append(n)
        means.append(total / n)
        spreads.append(cross / n - np.outer(means[-1], means[-1]))
    pooled = (counts[0] * spreads[0] + counts[1] * spreads[1]) / sum(counts)
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    parts = []
    for n, mean, spread in zip(counts, means, spreads, strict=True):
        drawn = ((1 - to_pooled) * spread + to_pooled * pooled) / np.outer(scale, scale)
        drawn = (1 - to_round) * drawn + to_round * max(1e-3, np.trace(drawn) / k) * np.eye(k)
        factor = np.linalg.cholesky(drawn)
        parts.append((np.log(n / sum(counts)) - np.log(np.diag(factor)).sum(), mean / scale, np.linalg.inv(factor)))
    return Discriminant(scale, parts)


def train(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled rows of ``measured`` (from :func:`features`) whose fold is not 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0))
    return fit(measured.join(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id"), "quality")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (the probability of label 1) and predicted (1 if score >= 0.3, else 0).

    Scores depend on the texts alone. Null texts are empty and are scored like any text; every row of ``docs``
    gives one row. Labels other than 0 and 1 are not learned from; a doc_id that is labelled more than once counts once,
    with its least label, and documents that share a doc_id all count. If only one label is there, all
    scores are that label; without labels they are 0.5.
    """
    measured = stored(features(docs), "quality-features")
    model = train(measured, labels)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(pdf[list(FEATURES)].to_numpy())})

    rows = measured.mapInPandas(judge, "doc_id long, score double")
    return rows.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def score_of(text: Column, model: Discriminant) -> Column:
    """The score of each text, as a column."""

    def score(texts: pd.Series) -> pd.Series:
        rows = [statistics((t or "").encode()) for t in texts]
        return pd.Series(model.score(np.array(rows).reshape(-1, len(FEATURES))))

    return F.pandas_udf(score, "double")(F.coalesce(text, F.lit("")))
