"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a cell is a pair of centroids. A query walks the pairs in
the order of their summed inner products with a heap, until the cells it passed hold the wanted part of all
entries, and the entries of those cells are ranked by their exact inner product in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagewell.llm.shared import batch, stored

CENTROIDS = 16
#: The codebooks are fitted on at most this many vectors, those with the smallest hashed ids.
SAMPLE = 20_000
ENTRIES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 4096


@dataclass
class Codebook:
    first: np.ndarray
    second: np.ndarray

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def nearest(x, centroids):
            return (x @ centroids.T - 0.5 * (centroids ** 2).sum(axis=1)).argmax(axis=1)

        return nearest(vectors[:, : self.half], self.first), nearest(vectors[:, self.half:], self.second)

    def walk(self, query: np.ndarray, held: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """Pairs of centroids, best sum first, until the pairs passed hold ``wanted`` entries."""
        one, two = self.first @ query[: self.half], self.second @ query[self.half:]
        by_one, by_two = np.argsort(-one, kind="stable"), np.argsort(-two, kind="stable")
        heap, seen, passed, found = [(-(one[by_one[0]] + two[by_two[0]]), 0, 0)], {(0, 0)}, [], 0
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            pair = int(by_one[i]), int(by_two[j])
            if held[pair]:
                passed.append(pair)
                found += held[pair]
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < len(by_one) and b < len(by_two) and (a, b) not in seen:
                    seen.add((a, b))
                    heapq.heappush(heap, (-(one[by_one[a]] + two[by_two[b]]), a, b))
        return passed


def _centroids(vectors: np.ndarray, count: int, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(vectors, axis=0)
    rng = np.random.default_rng(5)
    centroids = distinct[rng.choice(len(distinct), min(count, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = (vectors @ centroids.T - 0.5 * (centroids ** 2).sum(axis=1)).argmax(axis=1)
        for k in range(len(centroids)):
            if (own == k).any():
                centroids[k] = vectors[own == k].mean(axis=0)
    return centroids


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of the rows that take part: no nulls, only finite components, not all zero.

    Vectors of another length than most are left out as well.
    """
    v = F.col(vector_col).cast("array<double>")
    sizes = vectors.where(v.isNotNull()).groupBy(F.size(v).alias("size")).count()
    common = sizes.orderBy(F.desc("count"), "size").first()
    return vectors.where(F.size(v) == (common["size"] if common else 0)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0.0))


def fit(entries: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Codebook | None:
    """Codebooks from a bounded sample; None for an empty table."""
    rows = entries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toPandas()
    if rows.empty:
        return None
    x = np.vstack(rows["vector"].to_numpy())
    half = max(1, x.shape[1] // 2)
    return Codebook(_centroids(x[:, :half], centroids), _centroids(x[:, half:], centroids))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(entries: DataFrame, book: Codebook) -> DataFrame:
    """Every entry with its pair of centroids: vec_id, vector, one, two."""
    shared = entries.sparkSession.sparkContext.broadcast(book)
    schema = pa.schema([
        ("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("one", pa.int32()), ("two", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if part.num_rows:
                one, two = shared.value.assign(_matrix(part.column(1)))
                yield batch(schema, {"vec_id": part.column(0), "vector": part.column(1), "one": one, "two": two})

    return stored(
        entries.mapInArrow(run, "vec_id long, vector array<double>, one int, two int"), "multi-index")


def search(
    index: DataFrame, book: Codebook, queries: DataFrame, k: int = 20, visit: float = 0.65,
    entries_per_block: int = ENTRIES_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK,
) -> DataFrame:
    """The ``k`` nearest of each query found: query_id, rank, vec_id, score.

    ``queries`` has vec_id and vector; an entry with the query's id is no candidate. A query walks cells until
    they hold ``visit`` of all distinct vectors, and at least four times ``k``. Ties go to the smaller vec_id. Cells of
    any size are cut into blocks, so one common vector does not gather in a task. Rows of one id are one candidate, with
    the best of its scores, and one query, whose vector is the smallest of them.
    """
    spark = index.sparkSession
    # Copies of a vector are found together, so they count once on the way; blocks are cut by rows.
    cells = index.groupBy("one", "two", F.xxhash64("vector").alias("key")).agg(F.count("*").alias("n")).groupBy("one", "two").agg(
        F.count("*").alias("distinct"), F.sum("n").alias("n")).toPandas()
    held, rows = (np.zeros((len(book.first), len(book.second)), dtype=np.int64) for _ in range(2))
    held[cells["one"], cells["two"]], rows[cells["one"], cells["two"]] = cells["distinct"], cells["n"]
    wanted = max(int(np.ceil(visit * held.sum())), 4 * k)
    blocks = np.maximum(1, -(-rows.sum(axis=1) // entries_per_block))
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    query_blocks = max(1, -(-queries.count() // queries_per_block))
    shared = spark.sparkContext.broadcast((book, held, wanted, blocks))
    probes = pa.schema([
        ("one", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()),
        ("vector", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes, enough, cut = shared.value
        for part in batches:
            out = {name: [] for name in probes.names}
            for query_id, vector in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                vector = np.array(vector.as_py())
                rows: dict[int, list[int]] = {}
                for one, two in codes.walk(vector, sizes, enough):
                    rows.setdefault(one, []).append(two)
                for one, twos in rows.items():
                    for block in range(int(cut[one])):
                        for name, value in zip(probes.names, (one, block, query_id, vector, twos), strict=True):
                            out[name].append(value)
            yield batch(probes, out)

    def rank(key, entries: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(entries) and len(asked):
            # Copies of a row are dropped, so that the best k of a block are distinct.
            entries = entries.assign(key=entries["vector"].map(lambda v: v.tobytes())).drop_duplicates(["vec_id", "key"])
            entries = entries.sort_values("vec_id")
            x, ids, cell = np.vstack(entries["vector"]), entries["vec_id"].to_numpy(), entries["two"].to_numpy()
            most = int(np.unique(ids, return_counts=True)[1].max())
            for start in range(0, len(asked), 256):
                some = asked.iloc[start: start + 256]
                passed = np.zeros((len(some), cell.max() + 1), dtype=bool)
                for row, twos in enumerate(some["cells"]):
                    passed[row, twos[twos <= cell.max()]] = True
                score = np.vstack(some["vector"]) @ x.T
                own = some["query_id"].to_numpy()[:, None] == ids[None, :]
                score[~passed[:, cell] | own] = -np.inf
                for row, query_id in enumerate(some["query_id"]):
                    s = score[row]
                    # Rows of one id, at most ``most`` here, must not take the place of other ids.
                    take = k * most
                    floor = np.partition(s, len(s) - take)[len(s) - take] if len(s) > take else -np.inf
                    at = np.flatnonzero((s > -np.inf) & (s >= floor - 1e-9))
                    # Summed row by row, equal vectors get equal scores, so ties are real ties.
                    exact = (x[at] * some["vector"].iloc[row]).sum(axis=1)
                    best = np.argsort(-exact, kind="stable")
                    best = best[np.sort(np.unique(ids[at[best]], return_index=True)[1])][:k]
                    found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at[best]], "score": exact[best]}))
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return pd.concat(found) if found else empty

    asked = queries.mapInArrow(
        walk, "one int, block int, query_id long, vector array<double>, cells array<int>"
    ).withColumn("queries", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
    per_one = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("one") + 1)
    dealt = index.select(
        "one", F.pmod(F.xxhash64("vec_id"), per_one).cast("int").alias("block"), "vec_id", "vector", "two",
        F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")).alias("queries"))
    keys = ["one", "block", "queries"]
    near = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
