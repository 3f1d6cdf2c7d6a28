"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.runtime import stage

#: Rows handed to Python at once. Texts may be very long, so Spark's default of
#: 10,000 rows is no memory bound.
BATCH_ROWS = 512

#: Words of byte strings: bytes.split() without arguments cuts at exactly
#: these six ASCII characters and at nothing else.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frugal(spark: SparkSession) -> None:
    """Lower the Arrow batch size for this session; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []



def ascii_lower(column: Column) -> Column:
    """A to Z become a to z; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


__all__ = ["BATCH_ROWS", "WORD", "ascii_lower", "frugal", "stage", "words_of"]
