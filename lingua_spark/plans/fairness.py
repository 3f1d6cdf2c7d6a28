"""Tokenizer fairness report: cost per language and how even it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.operators.metrics import gini


def fairness_report(df: DataFrame, tokenizers: dict[str, Column], lang: str = "lang", text: str = "text") -> DataFrame:
    """Long table (metric, tokenizer, language, value) of fertility and
    compression per language and overall, and the Gini coefficient of the
    tokens per byte.

    The texts are read once for all tokenizers: each contributes one token
    count per row, and one partial aggregate per language is shuffled.
    """
    counted = df.select(
        lang,
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint").alias("n_words"),
        *[F.size(tokens).cast("bigint").alias(f"t_{name}") for name, tokens in tokenizers.items()],
    )
    sums = counted.groupBy(lang).agg(*[F.sum(c).alias(c) for c in counted.columns if c != lang])
    long = sums.select(
        F.col(lang).alias("language"),
        "n_bytes",
        "n_words",
        F.inline(
            F.array(
                *[F.struct(F.lit(name).alias("tokenizer"), F.col(f"t_{name}").alias("tokens")) for name in tokenizers]
            )
        ),
    )
    totals = long.groupBy("tokenizer").agg(*[F.sum(c).alias(c) for c in ("n_bytes", "n_words", "tokens")])
    every = long.unionByName(totals.withColumn("language", F.lit("TOTAL")))
    metrics = every.select(
        "tokenizer",
        "language",
        F.inline(
            F.array(
                F.struct(F.lit("fertility").alias("metric"), (F.col("tokens") / F.col("n_words")).alias("value")),
                F.struct(F.lit("compression_ratio").alias("metric"), (F.col("n_bytes") / F.col("tokens")).alias("value")),
            )
        ),
    )
    costs = long.select("tokenizer", (F.col("tokens") / F.col("n_bytes")).alias("cost"))
    fairness = gini(costs, "cost", ("tokenizer",)).select(
        "tokenizer", F.lit("TOTAL").alias("language"), F.lit("fairness_gini").alias("metric"), F.col("gini").alias("value")
    )
    return metrics.unionByName(fairness).select("metric", "tokenizer", "language", F.round("value", 6).alias("value"))
