"""Readers for the tables a deployment keeps in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; only the columns a job selects are read."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share when a table has fewer splits than there are cores.

    Text jobs are heavy per row, so a table kept in one small file would run in one task. A large
    table is left alone: its own splits already occupy the cluster, and no shuffle is added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The ``documents`` table in page shape: every document is a page of its source's site."""
    doc = F.col("doc_id").cast("string")
    return spread(table(spark, folder, "documents")).select(
        "doc_id",
        F.col("source").alias("site_id"),
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/doc-"), doc
        ).alias("source_url"),
        F.concat_ws(" ", F.lit("Document"), F.col("lang"), F.col("source")).alias("title"),
        F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:00' + make_dt_interval(cast(doc_id % 28 as int))").alias(
            "crawled_at"
        ),
        "text",
    )
