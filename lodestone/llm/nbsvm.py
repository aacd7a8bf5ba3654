"""Quality classifier: Naive Bayes support vectors.

A text is the set of its n-grams (words and pairs of neighbours), hashed to a fixed number of columns. A column's
weight in the input is the log of the ratio of its smoothed shares in the two classes; over inputs scaled so, a linear
hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by Platt's sigmoid, fitted on
labelled rows that the model has not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready_for_python

#: The fit reads at most so many labelled rows, the first by a hash of doc_id.
TRAINING_ROWS = 12_000
COLUMNS = 1 << 17
SMOOTHING = 1.0
COST = 0.1
EPOCHS = 12
CALIBRATION_SHARE = 0.25
TOKEN = re.compile(r"\w+|[^\w\s]")
KNOWN_TOKENS = 200_000


class Grams:
    """n-gram columns of texts; tokens' hashes are kept in a bounded table."""

    def __init__(self, columns: int = COLUMNS):
        self.columns, self.known = columns, {}

    def of(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall((text or "").lower())
        if len(self.known) > KNOWN_TOKENS:
            self.known = {}
        known = self.known
        if new := [t for t in set(tokens) if t not in known]:
            known.update(zip(new, (pd.util.hash_array(np.array(new, object), categorize=False) & np.uint64(0x7FFFFFFF)).tolist(), strict=True))
        one = np.fromiter((known[t] for t in tokens), np.int64, len(tokens))
        two = (one[:-1] * 1_000_003 + one[1:]) ^ 0x5BD1E995
        mix = np.concatenate([one * 2_654_435_761, two * 40_503]) & 0x7FFFFFFFFFFF
        return np.unique((mix >> 13) % self.columns)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    columns: int

    def margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum() / np.sqrt(max(1, len(columns))) + self.bias)

    def score(self, columns: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(columns) + self.shift, -40, 40))))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, columns: int) -> np.ndarray:
    counts = [np.full(columns, SMOOTHING), np.full(columns, SMOOTHING)]
    for x, y in zip(rows, labels, strict=True):
        counts[int(y)][x] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights over n-gram indicators and bias of the L1-loss linear SVM on inputs scaled by `ratio`.

    Each class weighs as much as the other. A text's input has length about 1: the ratios are divided by the root of
    the number of its n-grams. The weights returned already hold the ratio.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    limit = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    values = [ratio[x] / np.sqrt(max(1, len(x))) for x in rows]
    square = np.array([v @ v + 1.0 for v in values])
    alpha, w, bias = np.zeros(len(y)), np.zeros(len(ratio)), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(y)):
            x, v = rows[k], values[k]
            gradient = y[k] * (w[x] @ v + bias) - 1
            new = min(max(alpha[k] - gradient / square[k], 0.0), limit[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * y[k]
                w[x] += step * v
                bias += step
                alpha[k] = new
    return w * ratio, float(bias)


def sigmoid(margins: np.ndarray, labels: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that make margins probabilities (Newton steps on the log loss with Platt's softened targets)."""
    n1, n0 = (labels > 0).sum(), (labels <= 0).sum()
    goal = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        g = x @ (p - goal)
        h = (x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit(labelled: DataFrame, columns: int = COLUMNS, rows: int = TRAINING_ROWS) -> Model:
    """A model from (doc_id, text, label), of which it takes `rows` rows at most: the first by a hash of doc_id.

    These rows' n-grams come to the driver, where the model is fitted; more rows don't, also if they repeat a doc_id. A
    null label is left out. With labels of one class only, every text gets that class's share as its score.
    """
    ready_for_python(labelled.sparkSession)
    taken = labelled.where(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Grams(columns).of
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "grams": [of(t).astype(np.int32).tobytes() for t in frame["text"]]})

    first = taken.mapInPandas(grams, "doc_id long, label int, grams binary").orderBy(F.xxhash64("doc_id"), "doc_id", "label", "grams").limit(rows)
    found = sorted(first.collect(), key=lambda r: (_mixed(r["doc_id"]), r["doc_id"], r["label"], bytes(r["grams"])))
    labels = np.array([r["label"] for r in found], int)
    data = [np.frombuffer(r["grams"], np.int32) for r in found]
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros(columns), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))), columns)
    cut = int(len(data) * (1 - CALIBRATION_SHARE))
    ratio = log_count_ratio(data[:cut], labels[:cut], columns)
    weights, bias = dual_descent(data[:cut], labels[:cut], ratio)
    model = Model(weights, bias, 1.0, 0.0, columns)
    model.slope, model.shift = sigmoid(np.array([model.margin(x) for x in data[cut:]]), labels[cut:])
    return model


def _mixed(doc_id: int) -> int:
    return (int(doc_id) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, text, label) for the `rows` labels that come first by a hash of doc_id; one label for each doc_id."""
    first = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    first = first.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(first), "doc_id")  # at most `rows` rows


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, score), a row for each row: the chance of label 1.

    Empty and null texts have no n-grams and get the score of the bias alone. Texts are read whole. Rows that repeat a
    doc_id are scored one by one; further columns don't take part. An empty frame gives an empty frame.
    """
    ready_for_python(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the number of columns

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        of = Grams(model.columns).of
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "score": [model.score(of(t)) for t in frame["text"]]})

    return docs.select("doc_id", "text").mapInPandas(batches, "doc_id long, score double")
