"""Collects the registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sagewell.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` together with its SQL twin, if it has one."""

    def register(job):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return job(configure(spark), folder)

        run.__name__ = name
        run.__doc__ = job.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register
