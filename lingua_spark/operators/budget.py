"""Training-token budgets of tokenizers and model sizes on a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hidden size, MLP size, heads, key/value heads, layers.
MODEL_SIZES = {
    "30M": (256, 1536, 32, 8, 4),
    "100M": (768, 4608, 32, 8, 6),
    "300M": (1024, 6144, 32, 8, 12),
    "1B": (2048, 12288, 32, 8, 16),
    "3B": (3072, 12288, 24, 8, 28),
    "8B": (4096, 21504, 32, 8, 32),
}
TOKENS_PER_PARAM = 20
TOKENS_PER_STEP = 262144
# End of fixed values.


def fixed_parameters(hidden: int, mlp: int, heads: int, kv_heads: int, layers: int) -> int:
    """Parameters that do not depend on the vocabulary: attention with grouped
    keys and its two head norms, a two-matrix MLP, two norms per layer, one
    final norm."""
    head = hidden // heads
    attention = 2 * hidden * heads * head + 2 * hidden * kv_heads * head + 2 * head
    return layers * (attention + 2 * hidden * mlp + 2 * hidden) + hidden


def parameters(size: str, vocab_size: int, embeddings: bool = True) -> int:
    """Parameter count of a size; input and output embeddings are separate."""
    config = MODEL_SIZES[size]
    return fixed_parameters(*config) + (2 if embeddings else 1) * vocab_size * config[0]


def with_sizes(df: DataFrame, vocab: Column) -> DataFrame:
    """One row per model size: the fixed size list is exploded from a literal,
    so the grid needs no join."""
    grid = F.array(
        *[
            F.struct(
                F.lit(name).alias("model_size"),
                F.lit(fixed_parameters(*c)).cast("bigint").alias("fixed"),
                F.lit(c[0]).cast("bigint").alias("hidden"),
            )
            for name, c in MODEL_SIZES.items()
        ]
    )
    rows = df.select("*", F.inline(grid))
    return rows.withColumn("params", F.col("fixed") + 2 * vocab * F.col("hidden")).drop("fixed", "hidden")


def token_budget(
    tokenizers: DataFrame,
    tokens_per_param: int = TOKENS_PER_PARAM,
    tokens_per_step: int = TOKENS_PER_STEP,
    per_device: int = 2 * 2048,
    devices: int = 16,
    warmup_ratio: float = 0.01,
    seeds: tuple[int, ...] = (),
) -> DataFrame:
    """Per tokenizer (tokenizer, vocab_size, corpus_tokens) and model size:
    parameters, target tokens, steps, warm-up and the epochs of the tokenized
    corpus this takes."""
    accumulation = max(1, tokens_per_step // (per_device * devices))
    step = per_device * devices * accumulation
    rows = with_sizes(tokenizers, F.col("vocab_size").cast("bigint"))
    rows = rows.withColumn("target_tokens", F.col("params") * tokens_per_param)
    rows = rows.withColumn("max_steps", F.floor(F.col("target_tokens") / step).cast("bigint"))
    rows = rows.withColumn("warmup_steps", F.floor(F.col("max_steps") * F.lit(float(warmup_ratio))).cast("bigint"))
    rows = rows.withColumn("epochs", F.col("target_tokens") / F.col("corpus_tokens"))
    if seeds:
        rows = rows.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    return rows
