"""Registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as spark_entry
from check import compare
from lingua_spark.queries.sources import TABLES

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = spark_entry.queries(), spark_entry.oracle_sql()
# Learners have tests of their own; check.py runs these too.
QUICK = sorted(n for n in ORACLES if not n.startswith(("learn_", "encode_")))


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_oracle(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = db.execute(ORACLES[name])
    found = [d[0] for d in result.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    rows = [[r[i] for i in order] for r in result.fetchall()]
    assert compare(columns, [tuple(r) for r in df.select(*columns).collect()], rows) == ""


def test_entry_has_rows(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["metric", "tokenizer", "language", "value"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
