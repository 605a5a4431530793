"""Registration of queries and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stagewise.session import configure, shared_dir, ship_packages, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_packages(configure(spark), "stagewise", "workload")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the test tables, or some of its columns spread over all cores for expensive work on them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows.select(*columns)) if columns else rows


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder all executors can reach."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
