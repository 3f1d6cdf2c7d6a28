"""The word table every learner works on, and the merges applied to it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from lingua_spark.functions.pretok import byte_symbols, char_symbols, pretoken_rows, pretokens, symbol_array
from lingua_spark.functions.segmentation import merge_symbols
from lingua_spark.learn.coded import Coded
from lingua_spark.learn.flat import Flat, FlatCodes, added_up
from lingua_spark.runtime import stage, stage_spread, unstage


def word_counts(df: DataFrame, text: str = "text", preset: str = "byte_level", by: tuple[str, ...] = ()) -> DataFrame:
    """Pre-tokens with their counts: the one heavy shuffle of a learner, with
    partial counts per map task."""
    rows = pretoken_rows(df.select(*by, text), text, preset)
    return rows.groupBy(*by, "word").agg(F.count("*").alias("freq"))


def symbol_table(
    df: DataFrame,
    text: str = "text",
    preset: str = "byte_level",
    by: tuple[str, ...] = (),
    unit: str = "byte",
    counts: DataFrame | None = None,
) -> DataFrame:
    """(by, syms, freq) of ``counted_words`` to learn from."""
    symbols = byte_symbols("word") if unit == "byte" else char_symbols("word")
    return counted_words(df, text, preset, by, counts).select(*by, symbols.alias("syms"), "freq")


def counted_words(
    df: DataFrame, text: str = "text", preset: str = "byte_level", by: tuple[str, ...] = (), counts: DataFrame | None = None
) -> DataFrame:
    """(by, word, freq). Whole texts are not deduplicated, that would shuffle
    the corpus for next to nothing. ``counts`` are the texts' ``word_counts`` by
    these or more columns, if they are known already."""
    if counts is not None:
        counts = counts.groupBy(*by, "word").agg(F.sum("freq").alias("freq"))
    elif preset == "text":
        counts = df.select(*by, F.col(text).alias("word"), F.lit(1).cast("bigint").alias("freq"))
    else:
        counts = word_counts(df, text, preset, by)
    return counts.filter(F.col("word") != "").select(*by, "word", "freq")


def pair_key(left: str, right: str) -> str:
    return f"<{left}><{right}>"


class MergedWords:
    """A staged table of symbols or codes under a growing list of merges.

    ``advance`` applies an epoch's merges in one pass and stages the result;
    one staged copy of the words exists at a time, apart from the moment of the
    change. Symbols are kept in memory while an epoch's jobs scan them, and a
    lost executor costs one read of its share; codes are read from the disk.
    """

    def __init__(self, table: DataFrame | Coded):
        self.frame = table if isinstance(table, Coded) else stage_spread(table, "words")

    def advance(self, merges: list[tuple[str, str]], replaced: list[tuple[str, str]] = ()) -> None:
        """Apply merges in their order, then plain replacements of symbols.

        The last merge may make a symbol that existed before; it is applied on
        its own, so that it feeds no earlier one.
        """
        if isinstance(self.frame, Coded):
            splits = [(old[1:-1], *new[1:-1].split("><")) for old, new in replaced]
            self.frame = self.frame.merged([merges[:-1], merges[-1:]], splits)
            return
        symbols = segment_all(self.frame, merges[:-1]) if len(merges) > 1 else self.frame
        last = [(pair_key(*m), f"<{m[0]}{m[1]}>") for m in merges[-1:]]
        column = F.col("syms")
        for old, new in [*last, *replaced]:
            column = F.replace(column, F.lit(old), F.lit(new))
        staged = stage(symbols.withColumn("syms", column), "words").persist(StorageLevel.MEMORY_AND_DISK)
        staged.count()
        self.release()
        self.frame = staged

    def release(self) -> None:
        if isinstance(self.frame, Coded):
            unstage(self.frame.frame)
            return
        self.frame.unpersist()
        unstage(self.frame)


def neighbours(symbols: DataFrame, width: int, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``width`` adjacent symbols with the word's frequency."""
    parts = symbols.select(*by, "freq", symbol_array("syms").alias("_p"))
    parts = parts.filter(F.size("_p") >= width)
    n = F.size("_p") - (width - 1)
    slices = [F.slice("_p", F.lit(i + 1), n).alias(name) for i, name in enumerate(names)]
    return parts.select(*by, "freq", F.inline(F.arrays_zip(*slices)))


def summed_in_tasks(symbols: DataFrame | Coded, by: tuple[str, ...], of_part, keys: list[str], value: str) -> DataFrame:
    """Sums of ``value`` by group and ``keys`` of what ``of_part`` makes of the
    symbols or codes, added up in every task first. Segments of codes are codes."""
    codes = isinstance(symbols, Coded)
    rows = (symbols.frame if codes else symbols).select(*by, "syms", "freq")
    schema = StructType([*rows.select(*by).schema.fields] if by else [])
    for key in keys:
        schema = schema.add(key, BinaryType() if codes and key == "segment" else StringType())
    shared, kind = (rows.sparkSession.sparkContext.broadcast(symbols.replay), symbols.kind) if codes else (None, None)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = Flat
        if shared is not None:
            names = pa.array(list(shared.value.number), pa.string())
            flat = partial(FlatCodes, names=names, kind=kind, replay=shared.value)
        return added_up(batches, by, of_part, [*by, *keys], value, flat)

    parts = rows.mapInArrow(sums, schema.add(value, LongType()))
    return parts.groupBy(*by, *keys).agg(F.sum(value).alias(value))


def pair_counts(symbols: DataFrame | Coded, by: tuple[str, ...] = ()) -> DataFrame:
    return summed_in_tasks(symbols, by, Flat.pair_sums, ["left", "right"], "n")


def symbol_counts(symbols: DataFrame | Coded, by: tuple[str, ...] = ()) -> DataFrame:
    return summed_in_tasks(symbols, by, Flat.symbol_sums, ["token"], "n")


def windows(word: str, width: int, overlap: int) -> Column:
    """Parts of a word that start every ``width`` characters and reach
    ``overlap`` further, so that one endless word does not blow up an array
    of all its substrings."""
    starts = F.sequence(F.lit(0), F.floor((F.length(word) - 1) / width).cast("int"))
    return F.transform(starts, lambda i: F.substring(F.col(word), i * width + 1, F.lit(width + overlap)))


def segment_all(table: DataFrame, merges: list[tuple[str, str]], unrolled: int = 16) -> DataFrame:
    """Replay a merge list on a symbol table.

    Lists of up to ``unrolled`` merges become generated code; longer ones a loop
    over the pairs present in each word, with the ranks broadcast (bounded by
    the vocabulary).
    """
    if len(merges) <= unrolled:
        symbols = F.col("syms")
        for left, right in merges:
            symbols = F.replace(symbols, F.lit(pair_key(left, right)), F.lit(f"<{left}{right}>"))
        return table.withColumn("syms", symbols)
    ranks = table.sparkSession.sparkContext.broadcast({m: i for i, m in enumerate(merges)})

    @F.pandas_udf("string")
    def replay(column: pd.Series) -> pd.Series:
        return column.map(lambda s: "<" + "><".join(merge_symbols(s[1:-1].split("><"), ranks.value)) + ">")

    return table.withColumn("syms", replay("syms"))


__all__ = [
    "MergedWords",
    "counted_words",
    "neighbours",
    "pair_counts",
    "pair_key",
    "pretokens",
    "segment_all",
    "summed_in_tasks",
    "symbol_counts",
    "symbol_table",
    "windows",
    "word_counts",
]
