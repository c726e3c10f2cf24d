"""Hashed embeddings and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sagewell.operators.embedding import DIMENSIONS, Embedder, norms
from sagewell.operators.scan import scan_topk

VECTOR = "dims array<int>, weights array<double>, norm double"
#: Texts embedded at a time, and letters of them; a batch of vectors is many times the size of its texts.
TEXTS, LETTERS = 512, 4_000_000


def _slices(texts: list, base: int) -> Iterator[tuple[int, int]]:
    """Places (from ``base``) of at most ``TEXTS`` texts and, but for one longer text, ``LETTERS`` letters."""
    start, letters = 0, 0
    for at, text in enumerate(texts):
        size = len(text or "")
        if at > start and (at - start == TEXTS or letters + size > LETTERS):
            yield base + start, at - start
            start, letters = at, 0
        letters += size
    if texts:
        yield base + start, len(texts) - start


def _lists(rows: int, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The entries of every row that are not zero, as lists of places and of values."""
    row, used = np.nonzero(counts)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32())
    return (pa.ListArray.from_arrays(ends, pa.array(used, pa.int32())),
            pa.ListArray.from_arrays(ends, pa.array(counts[row, used], pa.float64())))


def with_vectors(df: DataFrame, text: str, dims: int = DIMENSIONS) -> DataFrame:
    """``df`` with ``dims, weights, norm``: sparse vectors of signed token counts, and their length.

    A row keeps its vector: exploding tokens into (id, dim) rows would shuffle about a thousand rows per chunk. A task
    holds the vectors of a few hundred texts, whatever the size of its input.
    """
    schema = StructType(df.schema.fields + StructType.fromDDL(VECTOR).fields)
    names = schema.names

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = Embedder(dims)
        for whole in batches:
            for block in range(0, whole.num_rows, TEXTS):
                texts = whole.column(text).slice(block, TEXTS).to_pylist()
                for at, rows in _slices(texts, block):
                    counts = embedder.counts(texts[at - block : at - block + rows])
                    part = whole.slice(at, rows)
                    yield pa.RecordBatch.from_arrays([*part.columns, *_lists(rows, counts), pa.array(norms(counts))], names=names)

    return df.mapInArrow(embed, schema)


def hashed_terms(df: DataFrame, id_col: str, text: str, dims: int = DIMENSIONS) -> DataFrame:
    """Sparse rows ``(id, dim, weight)`` of unit-length hashed embeddings."""
    vectors = with_vectors(df.select(id_col, text), text, dims)
    zipped = F.explode(F.arrays_zip("dims", "weights")).alias("t")
    return vectors.select(id_col, "norm", zipped).select(
        id_col, F.col("t.dims").alias("dim"), (F.col("t.weights") / F.col("norm")).alias("weight")
    )


def embed_distinct(df: DataFrame, text: str, dims: int = DIMENSIONS) -> DataFrame:
    """Vectors of a table in which equal texts are embedded once.

    The distinct step carries one row per text; the join back is on a hash key, where a text that
    makes up a large share of the rows is split by the adaptive skew join.
    """
    keyed = df.withColumn("text_key", F.sha2(F.col(text), 256))
    unique = keyed.groupBy("text_key").agg(F.any_value(text).alias("_text"))
    vectors = with_vectors(unique, "_text", dims).drop("_text")
    return keyed.join(vectors, "text_key")


def dense_as_sparse(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """A dense float array in the (dims, weights, norm) form of the scan."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return df.select(
        F.col(id_col),
        F.sequence(F.lit(0), F.size(vector) - 1).alias("dims"),
        doubles.alias("weights"),
        F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda a, x: a + x * x)).alias("norm"),
    )


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Exact cosine top ``k`` per query: ``query_id, chunk_id, score, rank``."""
    return scan_topk(chunks, queries, k).select("query_id", "chunk_id", F.col("base").alias("score"), "rank")
