"""Joins: parallel texts, language checks, enrichment of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.text import lang_code_parts
from lingua_spark.operators.corpus import lang_order
from lingua_spark.operators.ordered import position


def parallel_targets(languages: DataFrame, lang: str = "lang", code: str = "flores_code") -> DataFrame:
    """(lang, iso, script) of the languages that have a parallel code."""
    iso, script = lang_code_parts(code)
    return languages.filter(F.col(code) != "").select(lang, iso.alias("iso"), script.alias("script"))


def parallel_route(rows: DataFrame, targets: DataFrame, lang: str = "lang") -> DataFrame:
    """Send each parallel row to every language whose iso code matches and
    whose script is open or equal.

    An equi-join on the iso code. Whether ``targets`` is broadcast is left to
    Spark's own size limit, as a caller may bring any table.
    """
    t = targets.select(F.col("iso").alias("_iso"), F.col("script").alias("_script"), lang)
    open_or_equal = F.col("_script").isNull() | (F.col("iso_15924") == F.col("_script"))
    return (
        rows.filter(F.col("text").isNotNull())
        .join(t, (F.col("iso_639_3") == F.col("_iso")) & open_or_equal)
        .drop("_iso", "_script")
    )


def parallel_align(
    df: DataFrame, langs: list[str], lang: str = "lang", order: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per position with the j-th text of each language.

    Positions come from the blocked window; the alignment is one aggregate on
    the position, at most one text per language in each group.
    """
    wanted = df.filter(F.col(lang).isin(langs))
    placed = position(wanted.select(lang, order, text), [lang], order, "position")
    columns = [F.max(F.when(F.col(lang) == code, F.col(text))).alias(code) for code in langs]
    aligned = placed.groupBy("position").agg(F.count("*").alias("n_langs"), *columns)
    return aligned.filter(F.col("n_langs") == len(langs)).drop("n_langs")


def lang_parity_check(
    train: DataFrame, dev: DataFrame, lang: str = "lang", order: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Positions of each language in train and dev, with ``matches``; every
    row must match before a parity-aware run."""
    a = lang_order(train, lang, order, text).select(lang, F.col("position").alias("train_position"))
    b = lang_order(dev, lang, order, text).select(lang, F.col("position").alias("dev_position"))
    same = F.coalesce(F.col("train_position") == F.col("dev_position"), F.lit(False))
    return a.join(b, lang, "full").withColumn("matches", same)


def enrich(results: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """Left join; where both sides have a column the info's value wins if it
    has one."""
    shared = [c for c in info.columns if c in results.columns and c != key]
    extra = [c for c in info.columns if c not in results.columns]
    right = info.select(key, *[F.col(c).alias(f"_info_{c}") for c in shared], *extra)
    joined = results.join(right, key, "left")
    own = [
        F.coalesce(F.col(f"_info_{c}"), F.col(c)).alias(c) if c in shared else F.col(c)
        for c in results.columns
    ]
    return joined.select(*own, *extra)
