"""Interleaving sources and holding out the first documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.operators.ordered import (
    KEY,
    block_bounds,
    cut_at_rank,
    limit_of,
    numbered,
    position,
    up_to,
    with_key,
)
from lingua_spark.runtime import stage


def _source_table(df: DataFrame, source: str) -> DataFrame:
    """(source, rows, idx, n_sources) by sorted name; one row per folder."""
    from pyspark.sql import Window

    counts = df.groupBy(source).agg(F.count("*").alias("n"))
    everything = Window.partitionBy()
    return stage(
        counts.select(
            source,
            "n",
            F.row_number().over(Window.orderBy(source)).cast("bigint").alias("idx"),
            F.count("*").over(everything).alias("n_sources"),
        ),
        "sources",
    )


def interleave(
    df: DataFrame,
    source: str = "source",
    order: str | list[str] = "doc_id",
    stopping: str = "first_exhausted",
    ties: list[str] | None = None,
) -> DataFrame:
    """Round-robin over the sources with the global ``position`` (1-based).

    ``first_exhausted`` ends with the last row of the first source to run dry;
    ``all_exhausted`` repeats the shorter sources until every one was read
    once. The position is arithmetic on the rank within the source, so no
    global sort is needed. Nulls come first in the order, ties as in
    ``ordered.with_key``.
    """
    sources = _source_table(df, source)
    place = (F.col("rank") - 1) * F.col("n_sources") + F.col("idx")
    last = (F.col("n") - 1) * F.col("n_sources") + F.col("idx")
    end = F.min(last) if stopping == "first_exhausted" else F.max(last)
    stop = sources.agg(end.alias("stop")).first()["stop"]
    ranked = position(with_key(df, order, ties), [source], KEY, "rank").join(sources, source)
    if stopping == "all_exhausted":
        # The row returns each time its source starts over.
        rounds = F.floor((F.lit(stop) - F.col("idx")) / F.col("n_sources")) + 1
        again = F.sequence(F.col("rank").cast("bigint"), rounds.cast("bigint"), F.col("n"))
        ranked = ranked.filter(F.col("rank") <= rounds).withColumn("rank", F.explode(again))
    return ranked.filter(place <= stop).select(*df.columns, place.cast("bigint").alias("position"))


def take_skip(
    df: DataFrame,
    eval_docs: int,
    source: str = "source",
    order: str | list[str] = "doc_id",
    ties: list[str] | None = None,
) -> DataFrame:
    """Label the first ``eval_docs`` of the interleaved order ``eval``, the
    rest of it ``train``.

    Both limits are found per source on a narrow staged table; the documents
    are then labelled without a shuffle. Order and ties as in ``interleave``.
    """
    keyed = with_key(df, order, ties)
    narrow = stage(keyed.select(source, KEY), "order")
    sources = _source_table(narrow, source)
    stop = sources.agg(F.min((F.col("n") - 1) * F.col("n_sources") + F.col("idx")).alias("s")).first()["s"]
    if stop is None:
        return df.select("*", F.lit("train").alias("part"))
    bounds = block_bounds(narrow, KEY)

    def rows_within(limit: int):
        return F.greatest(F.lit(0), F.floor((F.lit(limit) - F.col("idx")) / F.col("n_sources")) + 1)

    def limits(count: int, name: str) -> DataFrame:
        ranks = sources.select(source, rows_within(count).cast("bigint").alias("rank")).filter("rank > 0")
        cuts = cut_at_rank(narrow, [source], KEY, ranks, bounds)
        return cuts.select(source, limit_of("cut", "tied", "held").alias(name))

    cuts = stage(limits(stop, "end").join(limits(min(eval_docs, stop), "eval"), source, "left"), "cuts")
    placed = numbered(keyed, [source], cuts, ["end", "eval"]).filter(up_to("end"))
    part = F.when(F.coalesce(up_to("eval"), F.lit(False)), "eval").otherwise("train")
    return placed.select(*df.columns, part.alias("part"))
