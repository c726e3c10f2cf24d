"""Sinks: insert-if-absent, last-write-wins upsert, derived-column back-fill, appends and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagewell.functions.urls import host, root_url
from sagewell.operators.rank import first_per


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``incoming`` whose key is new; inside the batch the first row in ``order`` wins.

    Copies of one key are pruned to one per task before the shuffle, so a key that fills a large
    part of the batch stays cheap.
    """
    winners = first_per(incoming, keys, order)
    return winners.join(target.select(*keys), keys, "left_anti")


def append_new(spark, path: str, incoming: DataFrame, keys: list[str], order: list[Column]) -> int:
    """Append the absent rows to a Parquet table and return how many were new.

    Running the same batch again adds nothing, so a retried streaming batch is harmless. The count
    is the growth of the stored table; the batch itself is computed once.
    """
    try:
        target = spark.read.parquet(path)
        before, new = target.count(), insert_if_absent(target, incoming, keys, order)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        before, new = 0, first_per(incoming, keys, order)
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def upsert_latest(target: DataFrame, incoming: DataFrame, keys: list[str], updated: str, created: str) -> DataFrame:
    """Last write per key wins, an incoming row over a stored one of the same time; the creation time is the
    earliest ever seen."""
    rest = [c for c in target.columns if c not in (*keys, updated, created)]
    both = target.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return (
        both.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.struct(updated, "_new", *rest)).alias("_last"),
            F.max(updated).alias(updated),
            F.min(created).alias(created),
        )
        .select(*keys, "_last.*", updated, created)
    )


def new_sites(chunks: DataFrame, sites: DataFrame, order: Column) -> DataFrame:
    """One site row per site of the chunks that has none yet, taken from its first chunk."""
    first = chunks.groupBy("site_id").agg(F.min_by("source_url", order).alias("source_url"))
    return first.join(sites.select("site_id"), "site_id", "left_anti").select(
        "site_id",
        root_url(F.col("source_url")).alias("root_url"),
        F.coalesce(F.nullif(host(F.col("source_url")), F.lit("")), F.lit("default")).alias("allowed_domain"),
    )


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Fill a derived column where it is empty; filled rows are left as they are."""
    empty = F.col(column).isNull() | (F.col(column) == "")
    return df.withColumn(column, F.when(empty, value).otherwise(F.col(column)))


def append_turns(turns: DataFrame, path: str) -> None:
    turns.write.mode("append").partitionBy("site_id").parquet(path)


def write_report(report: DataFrame, path: str, run_id: str) -> None:
    """One JSON folder per run; the run id is the caller's time stamp."""
    report.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)
