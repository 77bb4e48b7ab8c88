"""Quality classifier: regularised quadratic discriminant (operator 8).

Every text becomes a short vector of transformed statistics. Class counts, sums and
sums of squares over all labelled training rows (partial sums per partition, then one
aggregation of a fixed number of cells) give class means and covariances; covariances
are shrunk towards the pooled diagonal. A score is the logistic of the tempered
difference of the two Gaussian log densities, with Mahalanobis distances from Cholesky
factors that are computed once.

Defined cases: a null or empty text has the zero vector and is scored like any other;
a null doc_id is in no fold and matches no label; several labels of a document count as
often as they occur, null labels do not; repeated rows train as often as they occur and
are scored alike; very long texts are measured whole; a score equal to the cutoff is good;
without labels of both kinds every score is the share of label 1 (0.5 without any); an
empty table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, in_fold

FEATURES = ("words", "symbols", "capitals", "exclamations", "echo", "variety", "word_length", "repeated_lines", "bars", "digits", "stops", "top_word")
WIDTH = len(FEATURES)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
FOLDS, HELD_OUT, CUTOFF = 5, 0, 0.3


def features(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * WIDTH
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = int(seen[65:91].sum() + seen[97:123].sum()) + 1
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    echo = sum(map(bytes.__eq__, words, words[1:])) / n
    size = len(data) - int(seen[32]) - int(seen[9:14].sum())
    return [
        np.log1p(n) / 4,
        np.log1p(8.0 * seen[_SYMBOLS].sum() / n),
        np.sqrt(seen[65:91].sum() / letters),
        np.log1p(8.0 * seen[33] / n),
        np.sqrt(echo),
        np.log1p(len(counts)) / np.log1p(n),
        np.log(size / n),
        np.sqrt(1 - len(set(lines)) / len(lines)),
        np.log1p(8.0 * seen[124] / n),
        np.log1p(8.0 * seen[48:58].sum() / size),
        np.log1p(8.0 * seen[46] / n),
        np.sqrt(counts.most_common(1)[0][1] / n),
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def text_features(texts: pa.Array) -> pa.Array:
    flat = np.array([features(t) for t in texts.to_pylist()], float).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDTH), pa.int32()), pa.array(flat))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and constants of the classes 0 and 1."""

    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]
    share: float

    @staticmethod
    def fit(counts: np.ndarray, sums: np.ndarray, squares: np.ndarray, shrink: float = 0.1) -> Discriminant:
        total = counts.sum()
        if counts.min() < 2:
            return Discriminant((), (), (), float(counts[1] / total) if total else 0.5)
        mean = sums.sum(0) / total
        scale = np.diag(squares.sum(0) / total - np.outer(mean, mean)).clip(1e-6)
        means, factors, constants = [], [], []
        for k in (0, 1):
            own = sums[k] / counts[k]
            cov = squares[k] / counts[k] - np.outer(own, own)
            part = max(shrink, WIDTH / (WIDTH + counts[k]))
            cov = (1 - part) * (cov + cov.T) / 2 + part * np.diag(scale)
            lower = np.linalg.cholesky(cov + 1e-6 * np.eye(WIDTH))
            means.append(own)
            factors.append(np.linalg.inv(lower))
            constants.append(float(np.log(counts[k] / total) - np.log(np.diag(lower)).sum()))
        return Discriminant(tuple(means), tuple(factors), tuple(constants), float(counts[1] / total))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        one, two = (c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.constants))
        return 1 / (1 + np.exp(((one - two) / WIDTH).clip(-500, 500)))

    def column(self, vector: Column) -> Column:
        @F.arrow_udf(T.DoubleType())
        def scores(vectors: pa.Array) -> pa.Array:
            return pa.array(self.score(vectors.flatten().to_numpy().reshape(-1, WIDTH)))

        return scores(vector)


def fit(rows: DataFrame) -> Discriminant:
    """From rows (label, features): moments over all of them, whatever their number."""
    cells = 1 + WIDTH + WIDTH * WIDTH

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, cells))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
            for k in (0, 1):
                own = x[y == k]
                sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * cells)), pa.array(sums.ravel())], ["cell", "v"])

    got = rows.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    table = np.zeros(2 * cells)
    for row in got:
        table[row.cell] = row.v
    table = table.reshape(2, cells)
    return Discriminant.fit(table[:, 0], table[:, 1 : 1 + WIDTH], table[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH))


def training_rows(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, features) of labelled documents outside the held-out fold."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)")
    return measured.where(~in_fold("doc_id", FOLDS, HELD_OUT)).join(known, F.col("doc_id") == F.col("__id")).select("label", "features")


def measure(docs: DataFrame) -> DataFrame:
    return durable(docs.select("doc_id", text_features("text").alias("features")), "quality")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    measured = measure(docs)
    model = fit(training_rows(measured, labels))
    scored = measured.select("doc_id", in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), model.column(F.col("features")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that the classifier predicts as 1."""
    model = fit(training_rows(measure(docs), labels))
    return docs.where(model.column(text_features("text")) >= CUTOFF)
