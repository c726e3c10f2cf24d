"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagewell.session import configure, materialized

#: Rows per Arrow batch: documents may be long, so a batch is kept to a few megabytes of text.
TEXTS_PER_BATCH = "512"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the corpus operators; sizing stays with the caller."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return spark


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which also cuts its lineage."""
    return materialized(df, purpose)


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with every column but the ``used`` ones under a neutral name; ``toDF`` gives the names back.

    Rows that are handed on whole may carry columns of any name, also those that a job makes for itself.
    """
    return docs.toDF(*[name if name in used else f"extra_{at}" for at, name in enumerate(docs.columns)])


def fold(key: str, folds: int) -> Column:
    """crc32 of an id as text, modulo ``folds``; a null id counts as remainder 0."""
    digest = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.coalesce(digest % folds, F.lit(0)).cast("int")


def partitions_for(rows_or_bytes: int, share: int, spark: SparkSession) -> int:
    """Enough partitions for ``share`` units each, and no fewer than the session's shuffle partitions."""
    return max(-(-int(rows_or_bytes) // share), int(spark.conf.get("spark.sql.shuffle.partitions")))


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema
    )


def texts_of(column: pa.Array) -> Iterator[str | None]:
    """The values one by one, so that a batch never exists as Python strings as a whole."""
    for value in column:
        yield value.as_py()
