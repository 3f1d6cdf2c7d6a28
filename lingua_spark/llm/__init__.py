"""Operators for large training corpora; nothing else in the library uses them."""

from lingua_spark.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
