"""Contiguous shards of near equal bytes by global prefix sums.

Rows are put in order by a range shuffle of (key, checksum, size) only; texts
stay behind. Each range partition sums up its own rows in order, the totals of
the partitions are added up in partition order, and a row's global prefix is the
offset of its partition plus its local sum. The range of all bytes is cut at
equal targets: a row belongs to the shard in which its first byte falls, so
shards are contiguous and none exceeds its target by more than one row.

Everything wide is a few integers per row; what is added up globally is one row
per partition.

Defined cases: a null text has no bytes and checksum 0, and like every row
counts one byte for its end; a null key sorts first; rows with equal key are
ordered by checksum and size, and rows equal in all of these are
interchangeable; an empty table gives no rows. A key held by many rows still
spreads, because ties are dealt by position. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.llm.common import stage


def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition with its number and the sums before each row."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n, sizes = batch.num_rows, batch.column("size").to_numpy()
        columns = {
            "key": batch.column("key"),
            "size": batch.column("size"),
            "text_crc32": batch.column("text_crc32"),
            "part": pa.array(np.full(n, part, np.int32)),
            "rows_before": pa.array(rows + np.arange(n, dtype=np.int64)),
            "bytes_before": pa.array(total + np.cumsum(sizes) - sizes),
        }
        rows, total = rows + n, total + int(sizes.sum())
        yield pa.RecordBatch.from_pydict(columns)


def byte_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with size, checksum, shard and the row's place in its shard."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["key", "text_crc32", "size", "tie"]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    kind = dict(narrow.dtypes)["key"]
    schema = f"key {kind}, size bigint, text_crc32 bigint, part int, rows_before bigint, bytes_before bigint"
    # written once: totals and rows must come from the same partitions
    summed = stage(ranged.mapInArrow(local_sums, schema), "byte_shards")
    totals = summed.groupBy("part").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_offset"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_offset"),
        F.sum("bytes").over(everything).alias("bytes_total"),
    )
    # one row per partition of the shuffle, so it may be sent everywhere
    placed = summed.join(F.broadcast(offsets), "part").select(
        "key",
        "size",
        "text_crc32",
        (F.col("rows_offset") + F.col("rows_before")).alias("row"),
        F.expr(f"int(((bytes_offset + bytes_before) * {int(shards)}) div bytes_total)").alias("shard"),
    )
    starts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
