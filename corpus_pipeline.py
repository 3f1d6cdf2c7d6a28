"""A training-data pipeline of five stages over the table ``documents``.

Each stage is (name, function); a function takes the session, the documents its
predecessor kept and the folder of the tables, and returns a DataFrame that is
written as Parquet and read again by the next. All but the last return the
columns of the documents.

1. quality rules: documents that the compression bands or word rules reject go.
2. n-gram Jaccard join: of each group of exact and near copies one stays.
3. benchmark decontamination: documents that hold a test item go.
4. PII: spans of personal data are replaced by their kind.
5. BPE: every document becomes ids, and the digest of what they decode to.

The last stages depend on boosted trees, compression and a tokenizer file, which
SQL cannot express, so there is no oracle; the tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingua_spark.llm import bpe_prefix, chosen_path, decontaminate, pii_boost, quality_rules
from lingua_spark.runtime import stage

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosen_path.keep_one(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_boost.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_prefix.digest(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", deduplicate),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("pii", redact),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
