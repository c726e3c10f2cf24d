"""Stored vector lists: a vector table written by cell, and searches that read the probed cells and no other.

Centres come from a bounded sample; every vector is written to the folder of its nearest centre, cells with many rows in
parts. A query meets the rows of its nearest cells in matrix products, so pairs never become rows. Each cell knows the
smallest cosine between its centre and a member, which bounds what any member can score: an exact search goes on to
exactly those cells whose bound reaches the ``k``-th best score found so far, and stops.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.operators.embedding import DIMENSIONS
from sagewell.operators.rank import top_k
from sagewell.operators.vectors import with_vectors
from sagewell.session import materialized, scratch_folder

#: The centres are learnt from at most this many vectors (those with the smallest hashed ids), so many a cell.
SAMPLE, SAMPLE_PER_CELL, ROUNDS = 16_384, 32, 8
#: Numbers in one matrix: bounds the centres every task holds, and slices of a product.
NUMBERS = 8_000_000
PART_ROWS, QUERY_ROWS = 8_192, 2_048
DIGITS = 6
VECTOR = ["dims", "weights", "norm"]


@dataclass(frozen=True)
class VectorLists:
    """``rows``: chunk_id, dims, weights, norm, cosine, part, cell; ``cells``: cell, n, parts, least cosine; unit centres."""

    rows: DataFrame
    cells: DataFrame
    centres: np.ndarray


def cell_count(rows: int, width: int) -> int:
    """About as many cells as rows in a cell, while the centres stay within ``NUMBERS``."""
    return max(1, min(math.isqrt(max(rows, 1)), NUMBERS // max(width, 1)))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Row number of every element of a list column, and the elements."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _unit_rows(dims, weights, norm, width: int) -> np.ndarray:
    """Sparse rows as a dense matrix of unit vectors; slots beyond ``width`` do not exist in the lists."""
    at, slot = _lists(dims)
    value = _lists(weights)[1]
    held = slot < width
    out = np.zeros((len(dims), width))
    out[at[held], slot[held]] = value[held]
    return out / np.maximum(np.asarray(norm.to_numpy(zero_copy_only=False), dtype=float), 1e-300)[:, None]


def _slices(rows: int, width: int) -> Iterator[slice]:
    step = max(1, NUMBERS // max(1, width))
    return (slice(start, start + step) for start in range(0, rows, step))


def fit_centres(vectors: DataFrame, cells: int, width: int, seed: int = 7) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, from rounds of spherical k-means over the sample."""
    size = min(SAMPLE, SAMPLE_PER_CELL * cells, max(cells, 4 * NUMBERS // max(width, 1)))
    picked = vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(size)
    if "vector_text" in vectors.columns:
        picked = with_vectors(picked.repartition(vectors.sparkSession.sparkContext.defaultParallelism), "vector_text")
    picked = picked.select(*VECTOR).toArrow()
    x = np.unique(_unit_rows(picked["dims"], picked["weights"], picked["norm"], width), axis=0) if len(picked) else np.zeros((0, width))
    if not len(x):
        return np.zeros((1, width))
    centres = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _nearest(x: np.ndarray, own: np.ndarray, single: np.ndarray) -> np.ndarray:
    """The first nearest centre of every unit row. Single precision decides where no second one comes within its error."""
    rough = x.astype(np.float32) @ single.T
    cell = rough.argmax(axis=1)
    # A sum of n products of unit rows is off by at most n roundings, and two sums are compared.
    error = np.float32(4 * (x.shape[1] + 2) * np.finfo(np.float32).eps)
    close = np.flatnonzero((rough >= rough[np.arange(len(cell)), cell][:, None] - error).sum(axis=1) > 1)
    cell[close] = (x[close] @ own.T).argmax(axis=1)
    return cell


def build_lists(vectors: DataFrame, path: str | None = None, *, centres: np.ndarray | None = None, cells: int | None = None) -> VectorLists:
    """Write ``vectors`` (``chunk_id, dims, weights, norm``) by cell and read them back.

    A table of ``chunk_id, vector_text`` is embedded on the way, so its vectors are written once the cell is known. Ties between centres go to the first. ``centres`` may be given, one row each, of any length.
    """
    spark = vectors.sparkSession
    path = path or scratch_folder(spark, "vector-lists")
    if "vector_text" in vectors.columns:
        rows, width = vectors.count(), DIMENSIONS
    else:
        shape = vectors.agg(F.count("*").alias("n"), F.max(F.array_max("dims")).alias("last")).first()
        rows, width = shape["n"], (shape["last"] if shape["last"] is not None else 0) + 1
    if centres is None:
        centres = fit_centres(vectors, cells or cell_count(rows, width), width)
    centres = np.asarray(centres, dtype=float)
    centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    shared = spark.sparkContext.broadcast(centres)
    out = pa.schema([("chunk_id", pa.string()), ("dims", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())),
                     ("norm", pa.float64()), ("cell", pa.int32()), ("cosine", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        single = own.astype(np.float32)
        for whole in batches:
            for piece in _slices(whole.num_rows, max(own.shape)):
                part = whole.slice(piece.start, piece.stop - piece.start)
                x = _unit_rows(part["dims"], part["weights"], part["norm"], own.shape[1])
                cell = _nearest(x, own, single)
                yield pa.RecordBatch.from_arrays(
                    [*(part[name] for name in ("chunk_id", *VECTOR)), pa.array(cell, pa.int32()),
                     pa.array(np.einsum("ij,ij->i", x, own[cell]))], schema=out)

    if "vector_text" in vectors.columns:
        vectors = with_vectors(vectors.select("chunk_id", "vector_text"), "vector_text")
    assigned = vectors.select("chunk_id", F.col("dims").cast("array<int>"), F.col("weights").cast("array<double>"), "norm").mapInArrow(
        assign, "chunk_id string, dims array<int>, weights array<double>, norm double, cell int, cosine double")
    assigned = materialized(assigned, "assigned")
    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
    sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")).write.parquet(f"{path}/cells")
    # One row a cell, as many as there are centres: within the bound of what every task holds anyway.
    known = F.broadcast(spark.read.parquet(f"{path}/cells").select("cell", "parts"))
    parts = assigned.join(known, "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int")).drop("parts")
    parts.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame(
        [(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return read_lists(spark, path)


def read_lists(spark: SparkSession, path: str) -> VectorLists:
    """Stored vector lists."""
    rows = spark.read.schema(
        "chunk_id string, dims array<int>, weights array<double>, norm double, cosine double, part int, cell int").parquet(f"{path}/rows")
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return VectorLists(rows, spark.read.parquet(f"{path}/cells"), np.array([r["centre"] for r in centres]))


def _bounds(cosines: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest cosine a member can have, from the angles to the centre of the query and of the farthest member."""
    away = np.arccos(np.clip(cosines, -1, 1)) - np.arccos(np.clip(least, -1, 1))
    return np.cos(np.clip(away, 0, np.pi))


def probes_of(queries: DataFrame, lists: VectorLists, probes: int, reached: DataFrame | None = None) -> DataFrame:
    """``query_id, cell`` of the ``probes`` nearest cells that hold rows; with ``reached`` (query_id, kth) of the other
    cells that may still hold one of the best instead."""
    sizes = lists.cells.select("cell", "least").toPandas()
    least = np.full(len(lists.centres), np.nan)
    least[sizes["cell"]] = sizes["least"]
    shared = lists.rows.sparkSession.sparkContext.broadcast((lists.centres, least))
    out = pa.schema([("query_id", pa.int64()), ("cell", pa.int32())])
    asked, later = queries.select("query_id", *VECTOR), reached is not None
    asked = asked.withColumn("kth", F.lit(None).cast("double")) if not later else asked.join(reached, "query_id", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, least = shared.value
        held = np.flatnonzero(~np.isnan(least))
        for whole in batches:
            for piece in _slices(whole.num_rows, max(centres.shape)):
                part = whole.slice(piece.start, piece.stop - piece.start)
                # The centre of an empty vector is no direction; it is as far from one as from another.
                cosines = _unit_rows(part["dims"], part["weights"], part["norm"], centres.shape[1]) @ centres[held].T
                order = np.argsort(-cosines, axis=1, kind="stable")
                near = np.zeros(cosines.shape, dtype=bool)
                np.put_along_axis(near, order[:, :probes], True, axis=1)
                if later:
                    kth = part["kth"].to_numpy(zero_copy_only=False).astype(float)
                    # Scores are rounded, so a bound a rounding step below may still tie.
                    near = ~near & ((_bounds(cosines, least[held]) + 2 * 10.0 ** -DIGITS >= kth[:, None]) | np.isnan(kth)[:, None])
                row, at = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([
                    part["query_id"].take(pa.array(row)), pa.array(held[at], pa.int32())], schema=out)

    return asked.mapInArrow(choose, "query_id long, cell int")


def read_cells(lists: VectorLists, wanted: DataFrame) -> DataFrame:
    """The rows of the ``wanted`` cells (a small stored table); folders of other cells are not read."""
    # A condition that always holds marks the cells as worth pruning the folders for.
    return lists.rows.join(F.broadcast(wanted.where(F.col("cell") >= 0)), "cell")


def _scored(queries: DataFrame, lists: VectorLists, probes: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every query and group of rows it meets: query_id, chunk_id, score."""
    probes = materialized(probes, "probes")
    asked = probes.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    wanted = materialized(asked.join(lists.cells.select("cell", "parts"), "cell"), "wanted-cells")
    rows = read_cells(lists, wanted.select("cell", "blocks")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "part", "block", "chunk_id", *VECTOR)
    sides = probes.join(F.broadcast(wanted), "cell").join(queries.select("query_id", *VECTOR), "query_id").withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "query_id", *VECTOR)
    width, keys = lists.centres.shape[1], ["cell", "part", "block"]
    out = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.string()), ("score", pa.float64())])

    def best(held: pa.Table, some: pa.Table) -> pa.Table:
        found = [out.empty_table()]
        for mine in _slices(held.num_rows if some.num_rows else 0, width):
            part = held.slice(mine.start, mine.stop - mine.start)
            ids = np.array(part["chunk_id"].to_pylist(), dtype=object)
            x = _unit_rows(part["dims"], part["weights"], part["norm"], width)
            for asking in _slices(some.num_rows, max(width, len(ids))):
                here = some.slice(asking.start, asking.stop - asking.start)
                scores = np.round(_unit_rows(here["dims"], here["weights"], here["norm"], width) @ x.T, DIGITS)
                for query_id, score in zip(here["query_id"].to_pylist(), scores, strict=True):
                    floor = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
                    at = np.flatnonzero(score >= floor)
                    at = sorted(at.tolist(), key=lambda i: (-score[i], ids[i]))[:k]
                    found.append(pa.table([[query_id] * len(at), ids[at].tolist(), score[at]], schema=out))
        return pa.concat_tables(found)

    # Groups are long in work for their bytes: a fixed number of partitions keeps them from being put together.
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows, sides = (side.repartition(parts, *keys) for side in (rows, sides))
    return rows.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(
        lambda held, some: best(held, some), "query_id long, chunk_id string, score double")


def search_lists(
    queries: DataFrame, lists: VectorLists, k: int, *, probes: int, exact: bool = False, near: DataFrame | None = None,
) -> DataFrame:
    """Cosine top ``k`` of every query (``query_id, dims, weights, norm``): query_id, chunk_id, score, rank.

    ``probes`` cells are read for each query; an exact search then reads those whose bound reaches the ``k``-th best.
    Scores are rounded to six places, ties go to the smaller chunk id. ``near`` is what the search of the same queries, cells
    and ``k`` that is not exact has found, if it is stored already; the cells it has read are not read again.
    """
    order = [F.desc("score"), F.asc("chunk_id")]
    if near is not None and not exact:
        return near
    queries = materialized(queries.select("query_id", *VECTOR), "vector-queries")
    if near is None:
        near = top_k(_scored(queries, lists, probes_of(queries, lists, probes), k), ["query_id"], order, k)
        if not exact:
            return near
        near = materialized(near, "near")
    kth = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    more = _scored(queries, lists, probes_of(queries, lists, probes, kth), k)
    return top_k(near.drop("rank").unionByName(more), ["query_id"], order, k)
