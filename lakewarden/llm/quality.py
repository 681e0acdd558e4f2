"""Operator 8: document quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (lengths, vocabulary, repeated
words and lines, letter case, digits, symbols). Class means and covariances come from
sums over every labelled training row, added up map-side and by one small aggregation.
Covariances shrink towards the pooled one and its diagonal; their Cholesky factors are
computed once and a score is the difference of the two Mahalanobis log-densities,
calibrated by one slope and intercept (on at most about ``CALIBRATION_ROWS`` training
rows, chosen by hash).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from lakewarden.llm.shared import appended
from lakewarden.llm.toxicity import fit_logistic, fold, labelled, probability
from lakewarden.llm.words import Words, chunks

CALIBRATION_ROWS = 20_000
#: Weight of the pooled covariance, and of its diagonal, in each class covariance.
TO_POOLED, TO_DIAGONAL = 0.15, 0.05

_CLASSES = {
    "upper": [c for c in range(65, 91)],
    "digit": [c for c in range(48, 58)],
    "mark": [33, 63],
    "plain": [44, 46, 59, 58, 39, 34, 40, 41, 45],
    "symbol": [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126],
    "high": [c for c in range(128, 256)],
}
NAMES = ["words", "word_bytes", "vocabulary", "adjacent", "top_word", "trigrams", "lines", "line_copies", "short", *_CLASSES]


def _log(x):
    return np.log(x + 1e-3)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``NAMES`` a text; a text without words has the values of none."""
    words = Words(texts, lower=False)
    out = np.zeros((len(texts), len(NAMES)))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))
    size = np.maximum(lengths, 1)
    base = len(NAMES) - len(_CLASSES)
    for k, (_, members) in enumerate(_CLASSES.items()):
        table = np.zeros(256, np.int32)
        table[members] = 1
        # A prefix sum gives each text's count between its bounds.
        sums = np.concatenate(([0], np.cumsum(table[words.data])))
        out[:, base + k] = _log((sums[bounds[1:] - 1] - sums[bounds[:-1]]) / size)
    hashed = words.hash
    word_bytes = words.end - words.start
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        n = b - a
        lines = [x for x in texts[i].split(b"\n") if x.strip()]
        if n:
            own = hashed[a:b]
            counts = np.unique(own, return_counts=True)[1]
            grams = own[: max(1, n - 2)] * np.uint64(3)
            if n > 2:
                grams = own[:-2] * np.uint64(0x9E3779B97F4A7C15) + own[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + own[2:]
            out[i, :6] = (
                np.log(n),
                np.log(word_bytes[a:b].mean()),
                _log(1 - len(counts) / (n + 1)),
                _log((own[1:] == own[:-1]).sum() / n),
                _log(counts.max() / (n + 1)),
                _log(1 - len(np.unique(grams)) / (len(grams) + 1)),
            )
            out[i, 8] = _log((word_bytes[a:b] <= 2).mean())
        else:
            out[i, [2, 3, 4, 5, 8]] = _log(0)
        out[i, 6] = np.log1p(len(lines))
        out[i, 7] = _log(1 - len(set(lines)) / len(lines)) if lines else _log(0)
    return out


def _all_statistics(texts) -> np.ndarray:
    return np.concatenate([statistics(part) for _, part in chunks(texts)] or [np.zeros((0, len(NAMES)))])


class Discriminant:
    """Class means and Cholesky factors; ``difference`` is the log-density of class 1 less that of class 0."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        d = sums.shape[1]
        counts = np.maximum(counts, 1e-9)
        self.mean = sums / counts[:, None]
        own = squares / counts[:, None, None] - self.mean[:, :, None] * self.mean[:, None, :]
        pooled = (own * counts[:, None, None]).sum(axis=0) / counts.sum() + 1e-6 * np.eye(d)
        diagonal = np.diag(np.diag(pooled))
        # A class of few rows leans more on what both share.
        lean = np.minimum(1.0, TO_POOLED + d / (counts + d))[:, None, None]
        shrunk = (1 - TO_DIAGONAL) * ((1 - lean) * own + lean * pooled) + TO_DIAGONAL * diagonal + 1e-6 * np.eye(d)
        factors = np.linalg.cholesky(shrunk)
        self.inverse = np.stack([np.linalg.inv(f) for f in factors])
        self.logdet = np.array([np.log(np.diag(f)).sum() for f in factors])
        self.weights = np.array([np.log(counts[1] / counts[0]), 1.0]) if len(counts) == 2 else np.array([0.0, 1.0])

    def difference(self, x: np.ndarray) -> np.ndarray:
        density = []
        for c in range(2):
            z = (x - self.mean[c]) @ self.inverse[c].T
            density.append(-0.5 * (z * z).sum(axis=1) - self.logdet[c])
        # A signed square root keeps far outliers from ruling the calibration.
        gap = density[1] - density[0]
        return np.sign(gap) * np.sqrt(np.abs(gap))

    def score(self, x: np.ndarray) -> np.ndarray:
        return probability(self.weights, self.difference(x)[:, None])


def train(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on rows outside the held-out fold (``crc32 mod 3 = 1``); without any, scores are 0.5."""
    learned = fold("doc_id", 3) != 1
    known = labelled(docs.where(learned), labels.where(learned), "quality")
    d = len(NAMES)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, 1 + d + d * d))
        for frame in frames:
            x, y = _all_statistics(frame["text"]), frame["quality"].to_numpy()
            for c in range(2):
                own = x[y == c]
                held[c] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        for c in range(2):
            yield pd.DataFrame({"cls": c, "at": np.arange(held.shape[1]), "value": held[c]})

    total = known.select("text", "quality").mapInPandas(sums, "cls int, at int, value double")
    total = total.groupBy("cls", "at").agg(F.sum("value").alias("value")).toPandas()
    held = np.zeros((2, 1 + d + d * d))
    held[total["cls"], total["at"]] = total["value"]
    if not held[:, 0].all():
        empty = Discriminant(np.ones(2), np.zeros((2, d)), np.stack([np.eye(d)] * 2))
        empty.weights = np.zeros(2)
        return empty
    model = Discriminant(held[:, 0], held[:, 1 : 1 + d], held[:, 1 + d :].reshape(2, d, d))

    share = min(1.0, CALIBRATION_ROWS / max(1.0, held[:, 0].sum()))
    sample = known.where((F.abs(F.xxhash64("doc_id")) % 1_000_000) < F.lit(round(share * 1_000_000)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(frames):
        for frame in frames:
            yield pd.DataFrame({"x": shared.value.difference(_all_statistics(frame["text"])), "y": frame["quality"].to_numpy()})

    rows = sample.select("text", "quality").mapInPandas(measure, "x double, y int").toPandas()
    y = rows["y"].to_numpy(float)
    if len(y) and 0 < y.mean() < 1:
        model.weights = fit_logistic(rows[["x"]].to_numpy(), y)
    return model


def score_quality(docs: DataFrame, model: Discriminant, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with a score in (0, 1) added, all rows and other columns kept as they are.

    Null is scored as the empty text. Only the text is read for a score, so equal
    texts have equal scores, whatever the other columns hold. A column that is already
    called ``score_column`` is replaced. An empty table has an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        return lambda texts: [own.score(_all_statistics(texts))]

    return appended(docs.drop(score_column), [text_column], [StructField(score_column, DoubleType())], make)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
