"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.plans import operator_queries
from quern.plans.relational import SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def views(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Register the tables that a query names as temporary views."""
    for name in TABLES:
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, text)
        return spark.sql(text)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _runner(v if isinstance(v, str) else v[0]) for k, v in SQL.items()} | operator_queries.QUERIES
ORACLE_SQL: dict[str, str] = {k: v if isinstance(v, str) else v[1] for k, v in SQL.items()} | operator_queries.ORACLE_SQL
