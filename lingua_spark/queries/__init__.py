"""Registered queries: each runs an operator over whole test tables."""

from lingua_spark.queries import corpus, learners, results, sequences, sources, texts  # noqa: F401
from lingua_spark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
