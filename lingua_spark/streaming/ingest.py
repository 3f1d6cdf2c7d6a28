"""Structured Streaming over growing Parquet folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lingua_spark.functions.text import unify_text
from lingua_spark.learn.model import MergeModel, PieceModel
from lingua_spark.operators.sequences import pack_chunks
from lingua_spark.runtime import delete, exists, subfolders

VERSION = "version-"


def read_folder(
    spark: SparkSession, path: str, schema: StructType | str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of one folder reduced to a text column; other columns are kept
    for the caller to choose from."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(path)
    return rows.withColumn("text", unify_text(rows))


def read_folders(
    spark: SparkSession,
    folders: dict[str, str],
    schema: StructType | str,
    max_files_per_trigger: int | None = None,
    name: str = "source",
) -> DataFrame:
    """One stream of several folders, each row with its folder's name. The limit
    of files per trigger holds for each folder."""
    streams = [
        read_folder(spark, path, schema, max_files_per_trigger).withColumn(name, F.lit(label))
        for label, path in folders.items()
    ]
    return reduce(DataFrame.unionByName, streams)


def encoded_stream(
    rows: DataFrame,
    model: MergeModel | PieceModel,
    keep: tuple[str, ...] = (),
    max_length: int = 2048,
    as_tokens: bool = False,
) -> DataFrame:
    """Chunks of ids (or tokens) of a learned tokenizer from a text stream.

    Stateless; the model is broadcast when the stream is built and every
    trigger uses that copy.
    """
    encoded = model.encode(rows, as_tokens=as_tokens)
    return chunk_stream(encoded, F.col("input_ids"), keep, max_length)


def chunk_stream(rows: DataFrame, tokens: Column, keep: tuple[str, ...] = (), max_length: int = 2048) -> DataFrame:
    """Token chunks of a text stream: stateless, so nothing grows with it."""
    return pack_chunks(rows.select(*keep, tokens.alias("input_ids")), "input_ids", max_length)


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once: a restart from the checkpoint skips
    what is committed. Ends when the present input is read."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def count_stream(rows: DataFrame, path: str, checkpoint: str, by: tuple[str, ...] = ("source",)) -> StreamingQuery:
    """Running counts per group, one version of the table below ``path`` per
    trigger; ``read_counts`` gives the last whole one.

    The state is one counter per group. A version counts once its success file
    is there, so a reader never sees a half-written one. A trigger repeated
    after a failure writes an unfinished version anew and leaves a whole one.
    """

    def write_version(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/{VERSION}{batch_id:010d}"
        if not exists(batch.sparkSession, f"{folder}/_SUCCESS"):
            batch.write.mode("overwrite").parquet(folder)

    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return (
        counts.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_version)
        .trigger(availableNow=True)
        .start()
    )


def whole_versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a table of counts, oldest first."""
    folders = sorted(f for f in subfolders(spark, path) if f.rpartition("/")[2].startswith(VERSION))
    return [f for f in folders if exists(spark, f"{f}/_SUCCESS")]


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of what ``count_stream`` writes."""
    versions = whole_versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no finished counts below {path}")
    return spark.read.parquet(versions[-1])


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last whole versions, for when no reader is older."""
    for folder in whole_versions(spark, path)[:-keep]:
        delete(spark, folder)
