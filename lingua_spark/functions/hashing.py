"""Reproducible per-row randomness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_uniform(key: Column | str, seed: int = 42, purpose: str = "draw") -> Column:
    """A number in [0, 1) that depends on the seed, the purpose and the row key
    only.

    Unlike ``rand`` it does not change with partitioning, retries or order.
    Draws for different purposes are independent: a sample of the training rows
    must not depend on the draw that put them there.
    """
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.lit(f"{seed}:{purpose}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
