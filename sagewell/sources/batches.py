"""A table that grows by numbered batches: keys are looked up in the touched partitions only, and a batch counts when committed.

Rows lie in folders by batch and by a hash of their key. A batch writes its own folder first and then a one-row commit;
readers take no folder beyond the last commit. A batch that died in between writes its folder anew when it is
retried, so nothing is there twice, and a batch that comes again after its commit is left alone.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from sagewell.operators.rank import first_per
from sagewell.session import materialized

BUCKETS = 64


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch long, new_rows long").option("recursiveFileLookup", "true").parquet(f"{path}-commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_commit(spark: SparkSession, path: str) -> int | None:
    found = _commits(spark, path)
    return None if found is None else found.agg(F.max("batch")).first()[0]


def read_batches(spark: SparkSession, path: str, schema: StructType | str, last: int | None = None) -> DataFrame:
    """The committed rows, with ``_batch`` and ``_bucket``; batches are numbered upwards."""
    last = last_commit(spark, path) if last is None else last
    whole = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    whole = StructType([*whole.fields]).add("_batch", LongType()).add("_bucket", IntegerType())
    if last is None:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", path).parquet(path).where(F.col("_batch") <= last)


def commit_batch(spark: SparkSession, path: str, batch_id: int, new_rows: int) -> None:
    spark.createDataFrame([(batch_id, new_rows)], "batch long, new_rows long").coalesce(1).write.mode("overwrite").parquet(
        f"{path}-commits/{batch_id}")


def append_batch(
    spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: list[Column], batch_id: int, buckets: int = BUCKETS
) -> int:
    """Append the rows whose key is new, the first in ``order`` of each, and return how many there were.

    Only the partitions that hold a key of the batch are read; ``buckets`` must stay what it was for a table.
    """
    last = last_commit(spark, path)
    if last is not None and batch_id <= last:
        return _commits(spark, path).where(F.col("batch") == batch_id).agg(F.coalesce(F.sum("new_rows"), F.lit(0))).first()[0]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    fresh = materialized(first_per(incoming, keys, order).withColumn("_bucket", bucket), "batch")
    if last is not None:
        # At most ``buckets`` numbers; named in the condition, they are folders that are listed, the others are not.
        touched = [r["_bucket"] for r in fresh.select("_bucket").distinct().collect()]
        fresh = fresh.join(held_keys(spark, path, incoming.schema, keys, touched, last), ["_bucket", *keys], "left_anti")
    folder = f"{path}/_batch={batch_id}"
    fresh.select(*incoming.columns, "_bucket").repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
    new_rows = spark.read.schema(incoming.schema).parquet(folder).count()
    commit_batch(spark, path, batch_id, new_rows)
    return new_rows


def held_keys(spark: SparkSession, path: str, schema: StructType, keys: list[str], touched: list[int], last: int) -> DataFrame:
    """The keys stored in the ``touched`` buckets."""
    return read_batches(spark, path, schema, last).where(F.col("_bucket").isin(touched)).select("_bucket", *keys)
