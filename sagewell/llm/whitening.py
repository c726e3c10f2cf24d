"""Whitening of embeddings: exact sums, a centred covariance, its leading eigenpairs, and one projection a row.

Partitions add up whole-number sums and then products of centred vectors; the driver gets matrices whose size is
set by the dimensions alone and finds the eigenpairs by contour integration (``feast``). Rows are projected where
they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagewell.llm import feast
from sagewell.llm.shared import batch

COMPONENTS = 32
#: Doubles hold whole numbers exactly up to here; entries beyond it have no exact form to start from.
LARGEST = 2 ** 52


@dataclass
class Whitener:
    """What was fitted: ``n`` vectors, their exact ``sums``, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if self.trace else self.eigenvalues

    def offsets(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole numbers ``u`` and remainders ``r`` with ``x - sums / n = u - r / n``, without a large number."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums), strict=True)
        return x - np.array(whole, dtype=np.int64), np.array(rest, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        u, r = self.offsets(x)
        return u - r / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.eigenvalues))

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """The sums over the dimensions of ``(n * x - sums) ** 2``, exact for any ``n``."""
        u, r = self.offsets(x)
        if float(np.abs(u).max(initial=0) + 1) ** 2 * self.n * u.shape[1] >= 2 ** 62:
            u, r = u.astype(object), r.astype(object)
        squares, mixed, fixed = (u * u).sum(axis=1), (u * r).sum(axis=1), sum(int(c) ** 2 for c in r)
        return [Decimal(self.n ** 2 * int(a) - 2 * self.n * int(b) + fixed) for a, b in zip(squares, mixed, strict=True)]


def whole_vectors(table: DataFrame, vec_id: str, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``vec_id, x`` with ``floor(scale * c) + shift`` for an entry ``c``; one row for every row that takes part.

    Left out are rows whose vector is null, empty, or holds null or non-finite entries. Repeated rows count as often
    as they occur, a null id stays. Other columns are not read. Entries too large for exact sums raise.
    """
    c = F.col(vector).cast("array<double>")
    return table.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.transform(c, lambda e: F.when(
            ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.floor(scale * e) + F.lit(shift).cast("long"))).alias("x"),
    ).where(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda e: e.isNotNull()))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number and per-dimension sums of the vectors of the commonest length (the shortest of equally common ones)."""
    out = pa.schema([("size", pa.int32()), ("at", pa.int32()), ("total", pa.decimal128(38, 0))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Position -1 counts the vectors.
        totals: dict[int, list[int]] = {}
        for part in batches:
            lengths = np.diff(part.column(0).offsets.to_numpy())
            for size in np.unique(lengths):
                x = _matrix(part.column(0).filter(pa.array(lengths == size)))
                if np.abs(x.astype(float)).max() > LARGEST:
                    raise ValueError("entries of these vectors are too large for exact sums; use a smaller scale")
                here = [len(x), *(int(s) for s in x.astype(object).sum(axis=0))] if np.abs(x).max() > LARGEST // len(x) else [
                    len(x), *x.sum(axis=0).tolist()]
                totals[int(size)] = [a + b for a, b in zip(totals.get(int(size), [0] * len(here)), here, strict=True)]
        rows = [(size, at - 1, Decimal(s)) for size, sums in totals.items() for at, s in enumerate(sums)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield batch(out, dict(zip(out.names, columns, strict=True)))

    partial = rows.select("x").mapInArrow(add, "size int, at int, total decimal(38,0)").groupBy("size", "at").agg(
        F.sum("total").alias("total"))
    # Lengths are few; only the sums of the commonest come to the driver.
    counts = partial.where("at = -1").orderBy(F.desc("total"), "size").first()
    if counts is None:
        return 0, []
    found = partial.where((F.col("size") == counts["size"]) & (F.col("at") >= 0)).orderBy("at").collect()
    return int(counts["total"]), [int(r["total"]) for r in found]


def _products(rows: DataFrame, columns: int, view) -> np.ndarray:
    """The sum over the rows of ``v vᵀ`` for ``v = view(x)``, added up by partition and then by cell."""
    upper = np.triu_indices(columns)
    out = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for part in batches:
            if part.num_rows:
                v = view(_matrix(part.column(0)))
                total += v.T @ v
        if total.any():
            flat = total[upper]
            yield batch(out, {"cell": np.arange(len(flat), dtype=np.int32), "value": flat})

    cells = rows.select("x").mapInArrow(add, "cell int, value double").groupBy("cell").agg(
        F.sum("value").alias("value")).toPandas()
    total = np.zeros((columns, columns))
    flat = np.zeros(len(upper[0]))
    flat[cells["cell"].to_numpy(dtype=int)] = cells["value"].to_numpy()
    total[upper] = flat
    return total + np.triu(total, 1).T


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Fit on all rows of ``whole_vectors``. Of several lengths the commonest one is fitted.

    Components whose eigenvalue rounding cannot tell from zero do not exist, so there may be fewer than asked for, and
    none for equal vectors, a single vector or an empty table.
    """
    n, sums = _sums(rows)
    model = Whitener(n, sums, np.zeros(0), np.zeros((len(sums), 0)), 0.0)
    if not n:
        return model
    own = rows.where(F.size("x") == len(sums))
    covariance = _products(own, len(sums), model.centred) / n
    model.trace = float(np.trace(covariance))
    model.eigenvalues, model.components = feast.leading(covariance, components)
    k = len(model.eigenvalues)
    if k:
        # Whitened rows are centred already: their mean is zero but for rounding, whose square is nothing.
        model.identity_error = float(np.abs(_products(own, k, model.project) / n - np.eye(k)).max())
    return model


def whiten(rows: DataFrame, model: Whitener) -> DataFrame:
    """``vec_id, deviation, whitened`` for every row of the fitted length: the exact squared distance from the mean
    times ``n`` squared (decimal), and the coordinates along the components, each with variance one."""
    out = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                x = _matrix(part.column(1))
                yield batch(out, {"vec_id": part.column(0), "deviation": shared.value.deviations(x),
                                  "whitened": list(shared.value.project(x))})

    return rows.where(F.size("x") == len(model.sums)).mapInArrow(
        run, "vec_id long, deviation decimal(38,0), whitened array<double>")
