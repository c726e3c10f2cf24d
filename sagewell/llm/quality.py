"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are squashed to comparable ranges and mapped to cosine features whose inner
products approximate a Gaussian kernel. Partitions add up the normal equations, the driver solves a system of
fixed size, and calibration pools adjacent violators over a fixed grid of raw scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import batch, texts_of

STATISTICS = 20
FEATURES = 160
BANDWIDTH = 0.8
RIDGE = 1e-4
GRID = 1000
STATS = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("stats", pa.list_(pa.float64()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("fold", pa.int32()), ("score", pa.float64())])


def statistics(text: str) -> list[float]:
    """What a text looks like: lengths, character classes, repetition of words and lines."""
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size = max(1, int(data.sum()))
    words = text.split()
    n_words = max(1, len(words))
    seen = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    n_lines = max(1, len(lines))
    lower, upper, digits = data[97:123].sum(), data[65:91].sum(), data[48:58].sum()
    spaces = data[9:14].sum() + data[32]
    symbols = size - lower - upper - digits - spaces - data[128:].sum()
    stops = data[44] + data[46]
    pairs = Counter(zip(words, words[1:], strict=False))
    chars = data[data > 0] / size
    return [
        np.log1p(size) / 12, np.log1p(len(words)) / 10, np.log1p(n_lines) / 8,
        (size - spaces) / n_words / 20, len(seen) / n_words, max(seen.values(), default=0) / n_words,
        sum(1 for n in seen.values() if n == 1) / n_words,
        lower / size, 5 * upper / size, 5 * digits / size, spaces / size, data[128:].sum() / size,
        min(1.0, 5 * (symbols - stops) / size), min(1.0, 10 * stops / size), min(1.0, 5 * data[124] / size),
        min(1.0, 5 * data[35:39].sum() / size), len(set(lines)) / n_lines, np.log1p(size / n_lines) / 12,
        len(pairs) / max(1, len(words) - 1), -(chars * np.log(chars)).sum() / 5,
    ]


def document_statistics(docs: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fold, stats`` for every row; null and empty texts have the statistics of an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield batch(STATS, {
                "doc_id": part.column(0), "fold": part.column(1),
                "stats": [statistics(text or "") for text in texts_of(part.column(2))],
            })

    return docs.select(
        F.col(id_col).cast("long"), fold.cast("int"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, fold int, stats array<double>")


@dataclass
class Model:
    directions: np.ndarray
    phases: np.ndarray
    coefficients: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.cos(stats @ self.directions + self.phases) * np.sqrt(2.0 / FEATURES)
        return np.hstack([z, np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.coefficients

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated: linear between the pooled means, so distinct raw scores stay ordered."""
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def pooled(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing weighted means of the labels over ascending scores."""
    blocks: list[list[float]] = []
    for s, y, w in zip(score, label, weight, strict=True):
        blocks.append([s * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(train: DataFrame, calibration: DataFrame, seed: int = 7) -> Model:
    """Learn from ``(stats, label)`` rows; the ridge sees ``train``, calibration sees rows it did not.

    The driver receives ``FEATURES`` squared sums and ``GRID`` pooled scores, whatever the input. Without
    labelled rows every score is 0.5; without calibration rows the raw scores are used.
    """
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(scale=1 / BANDWIDTH, size=(STATISTICS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]),
    )
    width = FEATURES + 1
    upper = np.triu_indices(width + 1)
    cells = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def sums(batches):
        total = np.zeros((width + 1, width + 1))
        for part in batches:
            z = np.hstack([
                model.features(_matrix(part.column(0))),
                part.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1).astype(float),
            ])
            total += z.T @ z
        if total.any():
            flat = total[upper]
            yield batch(cells, {"cell": np.arange(len(flat), dtype=np.int32), "value": flat})

    rows = (
        train.select("stats", F.col("label").cast("double")).mapInArrow(sums, "cell int, value double")
        .groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    )
    if rows.empty:
        model.coefficients[-1] = 0.5
        return model
    flat = np.zeros(len(upper[0]))
    flat[rows["cell"].to_numpy()] = rows["value"].to_numpy()
    total = np.zeros((width + 1, width + 1))
    total[upper] = flat
    total = total + np.triu(total, 1).T
    penalty = RIDGE * total[width - 1, width - 1] * np.eye(width)
    penalty[-1, -1] = 0.0
    model.coefficients = np.linalg.solve(total[:width, :width] + penalty + 1e-9 * np.eye(width), total[:width, -1])

    grid = pa.schema([("bin", pa.int32()), ("raw", pa.float64()), ("label", pa.float64())])

    def raws(batches):
        for part in batches:
            raw = model.raw(_matrix(part.column(0)))
            bins = np.clip((raw + 0.5) * GRID / 2, 0, GRID - 1).astype(np.int32)
            yield batch(grid, {"bin": bins, "raw": raw, "label": part.column(1)})

    bins = (
        calibration.select("stats", F.col("label").cast("double"))
        .mapInArrow(raws, "bin int, raw double, label double")
        .groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("label").alias("label"), F.count("*").alias("n"))
        .toPandas().sort_values("raw")
    )
    if len(bins):
        knots, values = pooled(*(bins[c].to_numpy(dtype=float) for c in ("raw", "label", "n")))
        # Beyond the outermost means the score runs on to 0 and 1 over one more unit of raw score.
        model.knots = np.concatenate([[knots[0] - 1], knots, [knots[-1] + 1]])
        model.values = np.concatenate([[0.0], values, [1.0]])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``doc_id, fold, score`` for every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in batches:
            found = shared.value.score(_matrix(part.column(2))) if part.num_rows else []
            yield batch(SCORED, {"doc_id": part.column(0), "fold": part.column(1), "score": found})

    return stats.select("doc_id", "fold", "stats").mapInArrow(run, "doc_id long, fold int, score double")


def labels_of(labels: DataFrame, column: str = "quality") -> DataFrame:
    """One label per document: repeated labels are averaged and rounded up at one half, nulls are left out."""
    return (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg((F.avg(column) >= 0.5).cast("double").alias("label"))
    )
