"""Quality classifier: naive Bayes support vectors over n-gram indicators.

An indicator says that a text holds an n-gram of bytes at all. Indicators are scaled by the log
of the ratio of the two classes' counts, then a linear model with squared hinge loss is fitted by
dual coordinate descent, and its margin is turned into a probability by logistic regression over
rows that the fit has not seen. The model is fitted on at most ``FIT_ROWS`` labelled rows, in one
task; every text is scored whole, row by row, where it lies.

Null texts count as empty; an empty text has only its length indicator and gets a score, too.
Without rows of both classes the score is the share of label 1 (0.5 without any rows). Repeated
rows give repeated scores; only the text is an input of the score. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

#: Bound on the labelled rows that a model is fitted on.
FIT_ROWS = 8_000
BITS = 17
GRAMS = (2, 4, 6)
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
CALIBRATE_EVERY = 4
REPEATS = 100_000


def indicators(text: str | None) -> np.ndarray:
    """Numbers of the hashed n-grams that the text holds, and of what single n-grams can't show:
    its length with the share of different n-grams, and its share of bigrams of one word twice."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    seen = np.zeros(1 << BITS, bool)
    for n, factor in zip(GRAMS, _FACTORS, strict=True):
        if len(raw) < n:
            continue
        packed = raw[: len(raw) - n + 1].copy()
        for i in range(1, n):
            packed |= raw[i:len(raw) - n + 1 + i] << np.uint64(8 * i)
        seen[((packed * np.uint64(factor)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    different = int(np.count_nonzero(seen))
    size = len(raw).bit_length()
    share = min(15, 8 * different // max(1, len(raw)))
    seen[977 * size + 31 * share + 1] = True
    words = (text or "").split()
    twice = sum(map(eq, words, words[1:]))
    level = min(31, 64 * twice // max(1, len(words)))
    for least in range(level + 1):
        seen[REPEATS + least] = True
    return np.flatnonzero(seen).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Per indicator: the log of its smoothed share among label 1 over that among label 0."""
    share = []
    for label in (1, 0):
        counts = np.ones(1 << BITS)
        for row, y in zip(rows, labels, strict=True):
            if y == label:
                counts[row] += 1
        share.append(counts / (2 + np.count_nonzero(labels == label)))
    return np.log(share[0] / share[1])


def fit_dual(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 0.1, epochs: int = 6, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; each row is made of unit length."""
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    shrink = [1 / max(1e-12, float(np.sqrt(scale[row] @ scale[row]))) for row in rows]  # values are made anew each time: rows are long
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            row = rows[i]
            v = scale[row] * shrink[i]
            slope = sign[i] * (weights[row] @ v + bias) - 1 + alpha[i] / (2 * cost)
            new = max(0.0, alpha[i] - slope / (2.0 + 1 / (2 * cost)))  # 1 of the row and 1 of the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                alpha[i] = new
                weights[row] += step * v
                bias += step
    return weights, bias


def margin(row: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float) -> float:
    v = scale[row]
    return float(weights[row] @ v) / max(1e-12, float(np.sqrt(v @ v))) + bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the margin, by Newton steps with a small penalty."""
    x, theta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - labels) + 1e-2 * theta
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        theta = theta - np.linalg.solve(bend, slope)
    return float(theta[0]), float(theta[1])


def fit(texts: list[str | None], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scale, weights, [bias, slope, shift]); a constant score if only one class is there."""
    ones, n = int(np.count_nonzero(labels == 1)), len(labels)
    if ones in (0, n):
        rate = (ones + 0.5) / (n + 1)
        return np.zeros(1 << BITS), np.zeros(1 << BITS), np.array([0.0, 0.0, np.log(rate / (1 - rate))])
    rows = [indicators(t) for t in texts]
    aside = np.arange(n) % CALIBRATE_EVERY == 0
    if len(set(labels[aside])) < 2 or len(set(labels[~aside])) < 2:
        aside, use = np.ones(n, bool), np.ones(n, bool)
    else:
        use = ~aside
    fitted = [r for r, k in zip(rows, use, strict=True) if k]
    scale = log_count_ratios(fitted, labels[use])
    weights, bias = fit_dual(fitted, labels[use], scale)
    margins = np.array([margin(r, scale, weights, bias) for r, k in zip(rows, aside, strict=True) if k])
    return scale, weights, np.array([bias, *calibrate(margins, labels[aside].astype(float))])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        labels += batch.column("label").to_pylist()
    if labels:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (a.astype(np.float64).tobytes() for a in fit(texts, np.array(labels)))], names=["scale", "weights", "rest"])


class Model:
    """A fitted model: two arrays of 2 ** BITS numbers, whatever the input."""

    def __init__(self, scale: np.ndarray, weights: np.ndarray, rest: np.ndarray):
        self.scale, self.weights, self.rest = scale.astype(np.float32), weights.astype(np.float32), rest

    def scores(self, texts) -> np.ndarray:
        bias, slope, shift = self.rest
        margins = np.array([margin(indicators(t), self.scale, self.weights, bias) for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))


def fit_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labels, drawn by a hash of the id; so few of them are sent
    to all executors to find their texts. An id that documents repeat gives its least text once."""
    held_in = labels.select("doc_id", "label").filter("doc_id IS NOT NULL AND label IN (0, 1)")
    drawn = stored(held_in.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows))  # at most ``rows`` pairs of numbers
    texts = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("text", F.col("label").cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label 0 or 1; others are left out)."""
    found = fit_rows(docs, labels, rows)
    got = found.repartition(1).mapInArrow(_fit_task, "scale binary, weights binary, rest binary").collect()
    if not got:
        return Model(np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(3))
    return Model(*(np.frombuffer(bytes(x)) for x in got[0]))


def score(model: Model, text: str = "text") -> Column:
    """The probability of label 1 for a column of texts."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    return scored(F.col(text))


def held_out(doc_id: str = "doc_id") -> Column:
    """One row in five is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train_held_in(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of ``labels.quality``, learnt from the rows that are not held out."""
    return train(docs, labels.filter(~held_out()).select("doc_id", F.col("quality").alias("label")), rows)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold)."""
    model = train_held_in(docs, labels, rows)
    scored = docs.select("doc_id", held_out().alias("held_out"), score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
