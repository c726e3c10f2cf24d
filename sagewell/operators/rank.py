"""First-row and top-k helpers that stay cheap under skew.

``row_number() <= k`` over a window is pruned by Spark's window group limit before the shuffle, so a
key that holds a large share of all rows sends at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most ``k`` rows per key in the given order, with a 1-based rank."""
    number = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, number).filter(F.col(rank) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")
