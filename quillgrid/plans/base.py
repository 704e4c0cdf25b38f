"""Registering queries, and documents whose markup is generated from a table's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a callable under its name, with DuckDB SQL for its result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markup(spark: SparkSession, sf_dir: str, name: str, key: str, source: str) -> DataFrame:
    """documents(doc_id, source) from a table: source is a Spark SQL expression over its columns."""
    return table(spark, sf_dir, name).selectExpr(f"cast({key} as bigint) doc_id", f"{source} source")
