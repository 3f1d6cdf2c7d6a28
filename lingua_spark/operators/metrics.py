"""Tokenizer and loss metrics.

Formulas of the intrinsic metrics are this package's own definitions:

- fertility: tokens per white-space word
- compression ratio: UTF-8 bytes (or characters) per token
- vocabulary utilization: distinct tokens used / vocabulary size
- fairness: Gini coefficient of the per-language cost
- entropy: Shannon (or Rényi) entropy in bits of the token distribution
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.functions.text import word_count
from lingua_spark.runtime import stage


def text_costs(df: DataFrame, tokens: Column, by: tuple[str, ...], text: str = "text") -> DataFrame:
    """Per text the four sizes all metrics are ratios of."""
    return df.select(
        *by,
        F.size(tokens).cast("bigint").alias("n_tokens"),
        word_count(text).alias("n_words"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.length(text).cast("bigint").alias("n_chars"),
    )


def fertility(costs: DataFrame, by: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Tokens per word for each group and overall (``TOTAL``)."""
    agg = costs.rollup(*by).agg(
        F.sum("n_tokens").alias("tokens"),
        F.sum("n_words").alias("words"),
        F.avg(F.col("n_tokens") / F.nullif(F.col("n_words"), F.lit(0))).alias("mean_per_text"),
    )
    return agg.select(
        *[F.coalesce(F.col(c), F.lit("TOTAL")).alias(c) for c in by],
        "tokens",
        "words",
        (F.col("tokens") / F.nullif(F.col("words"), F.lit(0))).alias("fertility"),
        "mean_per_text",
    )


def compression(costs: DataFrame, by: tuple[str, ...] = ("lang",), unit: str = "bytes") -> DataFrame:
    """Bytes (or characters) per token for each group and overall."""
    size = f"n_{unit}"
    agg = costs.rollup(*by).agg(
        F.sum(size).alias("size"),
        F.sum("n_tokens").alias("tokens"),
        F.avg(F.col(size) / F.nullif(F.col("n_tokens"), F.lit(0))).alias("mean_per_text"),
    )
    return agg.select(
        *[F.coalesce(F.col(c), F.lit("TOTAL")).alias(c) for c in by],
        "size",
        "tokens",
        (F.col("size") / F.nullif(F.col("tokens"), F.lit(0))).alias("compression_ratio"),
        "mean_per_text",
    )


def vocab_utilization(
    tokens: DataFrame, vocab_size: int | Column, by: tuple[str, ...] = (), approximate: bool = False
) -> DataFrame:
    """Share of the vocabulary seen in ``tokens`` (one row per token).

    Tokens are reduced to distinct ones before they are counted, which hot
    tokens do not slow down.
    """
    used = F.approx_count_distinct("token") if approximate else F.count("*")
    rows = tokens.select(*by, "token") if approximate else tokens.select(*by, "token").distinct()
    size = F.lit(vocab_size) if isinstance(vocab_size, int) else vocab_size
    return rows.groupBy(*by).agg(used.alias("used")).withColumn("utilization", F.col("used") / size)


def gini(costs: DataFrame, cost: str = "cost", by: tuple[str, ...] = ()) -> DataFrame:
    """Gini coefficient over one cost per language; small by construction."""
    order = Window.partitionBy(*by).orderBy(cost)
    ranked = costs.withColumn("_i", F.row_number().over(order))
    n, total = F.count("*"), F.sum(cost)
    value = 2 * F.sum(F.col("_i") * F.col(cost)) / (n * total) - (n + 1) / n
    return ranked.groupBy(*by).agg(n.alias("languages"), value.alias("gini"))


def entropy(tokens: DataFrame, by: tuple[str, ...] = (), renyi: float | None = None) -> DataFrame:
    """Entropy in bits of the token distribution (one row per token in).

    H = log2(N) - sum(n log2 n)/N needs only the per-token counts, no second
    pass for the total.
    """
    counts = tokens.groupBy(*by, "token").agg(F.count("*").alias("n"))
    return entropy_of_counts(counts, by, renyi)


def entropy_of_counts(counts: DataFrame, by: tuple[str, ...] = (), renyi: float | None = None) -> DataFrame:
    n = F.col("n").cast("double")
    if renyi is None or renyi == 1:
        agg = counts.groupBy(*by).agg(
            F.sum(n).alias("_t"), F.sum(n * F.log2(n)).alias("_s"), F.count("*").alias("types")
        )
        value = F.log2("_t") - F.col("_s") / F.col("_t")
    else:
        agg = counts.groupBy(*by).agg(
            F.sum(n).alias("_t"), F.sum(F.pow(n, F.lit(renyi))).alias("_s"), F.count("*").alias("types")
        )
        value = (F.log2("_s") - renyi * F.log2("_t")) / (1 - renyi)
    return agg.select(*by, "types", F.col("_t").cast("bigint").alias("tokens"), value.alias("entropy"))


def loss_metrics(losses: DataFrame, by: tuple[str, ...] = ("model",), extra: str | None = None) -> DataFrame:
    """Perplexity per token and byte and bits per byte from per-text
    (nll, n_tokens, n_bytes); with ``extra`` also per that column."""
    sums = [F.sum(c).alias(c) for c in ("nll", "n_tokens", "n_bytes")]
    examples = F.count("*").alias("num_examples")
    if extra:
        keys = [F.col(c) for c in by]
        agg = losses.groupingSets([keys, [*keys, F.col(extra)]], *keys, F.col(extra)).agg(examples, *sums)
        agg = agg.withColumn(extra, F.coalesce(F.col(extra), F.lit("TOTAL")))
    else:
        agg = losses.groupBy(*by).agg(examples, *sums)
    per_token = F.col("nll") / F.col("n_tokens")
    per_byte = F.col("nll") / F.col("n_bytes")
    return agg.select(
        *by,
        *([extra] if extra else []),
        "num_examples",
        F.exp(per_byte).alias("perplexity_per_byte"),
        (per_byte / math.log(2)).alias("bits_per_byte"),
        F.exp(per_token).alias("perplexity_per_token"),
    )


def clipped_perplexities(loss: Column | str, chars_per_token: Column, bytes_per_token: Column) -> list[Column]:
    loss = F.col(loss) if isinstance(loss, str) else loss
    top = F.lit(20.0)
    return [
        F.exp(F.least(loss, top)).alias("ppl"),
        F.exp(F.least(loss / chars_per_token, top)).alias("char_ppl"),
        F.exp(F.least(loss / bytes_per_token, top)).alias("byte_ppl"),
    ]


def vocab_fertility(vocab: DataFrame, special: DataFrame, token: str = "token") -> DataFrame:
    """Mean characters and bytes per vocabulary entry, without special and
    empty tokens; 1.0 each for an empty rest."""
    rest = vocab.join(special.select(token), token, "left_anti").filter(F.col(token) != "")
    return rest.agg(
        F.coalesce(F.avg(F.length(token)), F.lit(1.0)).alias("chars_per_token"),
        F.coalesce(F.avg(F.octet_length(token)), F.lit(1.0)).alias("bytes_per_token"),
    )


def token_pairs(tokens: Column) -> Column:
    """Array of (prev, cur) of neighbours in a token array."""
    # Beyond the end slice gives an empty array, so short texts give no pairs.
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("prev"), F.slice(tokens, F.lit(2), n).alias("cur"))


def bigram_nll(
    train: DataFrame, held_out: DataFrame, key: str, tokens: str = "tokens", k: float = 0.1
) -> DataFrame:
    """Per held-out text the negative log-likelihood under an add-k bigram
    model of ``train``: (key, nll, n_tokens), first token excluded.

    The training texts are read once and their pairs counted first, with
    partial counts per task, so that a frequent pair is a row per task and not
    one per occurrence. The first token of a text counts as following nothing:
    the one table then also holds all tokens, for the smoothing.
    """
    wanted = stage(
        held_out.select(key, F.inline(token_pairs(F.col(tokens))))
        .groupBy(key, "prev", "cur")
        .agg(F.count("*").alias("m")),
        "pairs",
    )
    begun = F.concat(F.array(F.lit(None).cast("string")), F.col(tokens))
    counts = stage(
        train.select(F.inline(token_pairs(begun))).groupBy("prev", "cur").agg(F.count("*").alias("n")), "bigrams"
    )
    v = counts.select("cur").distinct().count()
    pairs = counts.filter(F.col("prev").isNotNull())
    prevs = pairs.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    seen = wanted.join(pairs, ["prev", "cur"], "left").join(prevs, "prev", "left")
    p = (F.coalesce(F.col("n"), F.lit(0)) + k) / (F.coalesce(F.col("n_prev"), F.lit(0)) + k * v)
    return seen.groupBy(key).agg(
        F.sum(F.col("m") * -F.log(p)).alias("nll"), F.sum("m").cast("bigint").alias("n_tokens")
    )


def score_texts(df: DataFrame, score_fn, schema: str) -> DataFrame:
    """Hook for a user's own model: ``score_fn(pandas frame) -> pandas frame``
    per Arrow batch, e.g. giving (model, doc_id, nll, n_tokens, n_bytes)."""

    def batches(frames):
        for frame in frames:
            yield score_fn(frame)

    return df.mapInPandas(batches, schema)
