"""Token sequences: truncation, fixed-length chunks, yield report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truncate(ids: Column | str, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def chunk_ids(ids: Column | str, max_length: int) -> Column:
    """Full, non-overlapping chunks; the remainder is dropped."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    n_chunks = F.floor(F.size(ids) / max_length).cast("int")
    # sequence(0, -1) would count down, so short texts are handled apart.
    starts = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.slice(ids, i * max_length + 1, max_length))


def pack_chunks(df: DataFrame, ids: str = "input_ids", max_length: int = 2048) -> DataFrame:
    """One row per full chunk; narrow, so a long text stays in its task."""
    others = [c for c in df.columns if c != ids]
    return df.select(*others, F.posexplode(chunk_ids(ids, max_length)).alias("chunk_no", ids))


def chunk_yield(df: DataFrame, ids: str = "input_ids", max_length: int = 2048, by: tuple[str, ...] = ()) -> DataFrame:
    """How many documents give a chunk, and how many tokens are dropped."""
    n = F.size(ids).cast("bigint")
    return df.groupBy(*by).agg(
        F.count("*").alias("docs"),
        F.count_if(n >= max_length).alias("docs_with_chunk"),
        F.sum(F.floor(n / max_length)).cast("bigint").alias("chunks"),
        F.sum(n % max_length).cast("bigint").alias("tokens_dropped"),
        F.sum(n).cast("bigint").alias("tokens"),
        F.round(F.avg((n >= max_length).cast("double")), 6).alias("share"),
    )


def flat_map(df: DataFrame, fn, returns: str, *columns: str) -> DataFrame:
    """A user's map from one row to any number of rows, as a Python table
    function: ``fn(*values)`` yields tuples of the schema ``returns``."""

    class Rows:
        def eval(self, *values):
            yield from fn(*values)

    table = F.udtf(Rows, returnType=returns)
    return df.lateralJoin(table(*[F.col(c).outer() for c in columns]))
