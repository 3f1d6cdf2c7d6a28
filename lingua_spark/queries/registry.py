"""Names of the queries, their callables and DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL of the row hash for a purpose and a key expression, seed 42.
HASH = "(('0x' || substr(md5('42:{purpose}:' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0)"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def values(rows: list[tuple]) -> str:
    """SQL VALUES list of literal rows."""

    def literal(v):
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
