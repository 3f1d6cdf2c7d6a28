"""Rank correlation of results between model sizes.

All size pairs go through one plan. Ranks come from distinct values with their
counts and a blocked running sum; Kendall's concordant pairs are counted level
by level on the bits of the x rank, n log n rows instead of all n² pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.significance import kendall_p_udf, spearman_p_udf
from lingua_spark.operators.ordered import running_total
from lingua_spark.runtime import stage

PAIR = ["small_model", "large_model"]


def seed_means(results: DataFrame, size: str, tokenizer: str, metric: str) -> DataFrame:
    return results.groupBy(F.col(size).alias("model_size"), F.col(tokenizer).alias("tokenizer_path")).agg(
        F.avg(metric).alias("metric_mean")
    )


def size_value(size: Column | str) -> Column:
    """'300M' -> 3e8; null where the name is no number with a unit."""
    size = F.col(size) if isinstance(size, str) else size
    number = F.try_to_number(F.regexp_extract(size, r"^([0-9]+(?:\.[0-9]+)?)[KMBT]$", 1), F.lit("999999.999"))
    unit = F.element_at(
        F.create_map(*[F.lit(x) for kv in (("K", 1e3), ("M", 1e6), ("B", 1e9), ("T", 1e12)) for x in kv]),
        F.right(size, F.lit(1)),
    )
    return number.cast("double") * unit


def size_key(size: Column | str, string_order: bool = False) -> Column:
    """Sort key of a size: numeric, or by name on request and for names
    without a number."""
    size = F.col(size) if isinstance(size, str) else size
    value = F.lit(None).cast("double") if string_order else size_value(size)
    return F.struct(value.alias("value"), size.alias("name"))


def size_pairs(results: DataFrame, size: str = "model_size", string_order: bool = False) -> DataFrame:
    """All (small, large) pairs of the distinct sizes.

    The sizes are a handful of names gathered into one sorted array.
    """
    names = F.transform(
        F.array_sort(F.collect_set(size_key(size, string_order))), lambda s: s["name"]
    )
    sizes = results.select(size).distinct().agg(names.alias("names"))
    left = sizes.select(F.posexplode("names").alias("i", "small_model"), "names")
    rest = F.slice("names", F.col("i") + 2, F.size("names"))
    return left.select("small_model", F.explode(rest).alias("large_model"))


def merge_sizes(means: DataFrame, string_order: bool = False) -> DataFrame:
    """Tokenizers two sizes have in common: one row per (pair, tokenizer).

    An equi-join on the tokenizer; it has one row per size on either side.
    """
    keyed = means.withColumn("_key", size_key("model_size", string_order)).filter(
        F.col("metric_mean").isNotNull()
    )
    small = keyed.select(
        "tokenizer_path",
        F.col("model_size").alias("small_model"),
        F.col("metric_mean").alias("metric_small"),
        F.col("_key").alias("_small"),
    )
    large = keyed.select(
        "tokenizer_path",
        F.col("model_size").alias("large_model"),
        F.col("metric_mean").alias("metric_large"),
        F.col("_key").alias("_large"),
    )
    return small.join(large, "tokenizer_path").filter(F.col("_small") < F.col("_large")).drop("_small", "_large")


def ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Per distinct value of the group: its count ``n``, the number of smaller
    rows ``less`` and the average rank of ties."""
    counts = stage(df.groupBy(*group, value).agg(F.count("*").alias("n")), "values")
    running = running_total(counts, group, value, "n", "_upto")
    less = F.col("_upto") - F.col("n")
    return running.select(*group, value, "n", less.alias("less"), (less + (F.col("n") + 1) / 2).alias("rank"))


def _ranked(merged: DataFrame) -> DataFrame:
    x = ranks(merged, PAIR, "metric_small").withColumnsRenamed({"less": "x_less", "rank": "x_rank", "n": "x_n"})
    y = ranks(merged, PAIR, "metric_large").withColumnsRenamed({"less": "y_less", "rank": "y_rank", "n": "y_n"})
    rows = merged.groupBy(*PAIR, "metric_small", "metric_large").agg(F.count("*").alias("n"))
    return stage(rows.join(x, [*PAIR, "metric_small"]).join(y, [*PAIR, "metric_large"]), "ranked")


def _spearman(ranked: DataFrame) -> DataFrame:
    """Pearson correlation of the ranks, weighted by the rows behind each."""
    w = F.col("n").cast("double")
    mid = (F.col("_all") + 1) / 2
    totals = ranked.groupBy(*PAIR).agg(F.sum("n").alias("_all"))
    rows = ranked.join(totals, PAIR).withColumns({"_x": F.col("x_rank") - mid, "_y": F.col("y_rank") - mid})
    return rows.groupBy(*PAIR).agg(
        F.sum("n").alias("n"),
        (
            F.sum(w * F.col("_x") * F.col("_y"))
            / F.nullif(
                F.sqrt(F.sum(w * F.col("_x") * F.col("_x"))) * F.sqrt(F.sum(w * F.col("_y") * F.col("_y"))),
                F.lit(0.0),
            )
        ).alias("spearman_rho"),
    )


def spearman(merged: DataFrame, p_value: bool = True) -> DataFrame:
    """Rho per size pair with at least two common tokenizers."""
    out = _spearman(_ranked(stage(merged, "merged"))).filter(F.col("n") >= 2)
    return out.withColumn("spearman_p", spearman_p_udf("spearman_rho", "n")) if p_value else out


def _tie_sums(df: DataFrame, key: str, count: str, prefix: str) -> DataFrame:
    t = F.col("_t").cast("double")
    per_value = df.groupBy(*PAIR, key).agg(F.first(count).cast("bigint").alias("_t"))
    return per_value.groupBy(*PAIR).agg(
        (F.sum(F.col("_t") * (F.col("_t") - 1)) / 2).cast("bigint").alias(f"{prefix}0"),
        F.sum(t * (t - 1) * (t - 2)).alias(f"{prefix}1"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{prefix}2"),
    )


def _concordant(ranked: DataFrame) -> DataFrame:
    """Pairs with x and y in the same order.

    Two x ranks differ first at exactly one bit: they share the bits above it
    and the smaller has a 0 there. Per bit and shared prefix, rows with a 1
    count the rows with a 0 and a smaller y.
    """
    bits = F.ceil(F.log2(F.col("_all").cast("double"))).cast("int")
    totals = ranked.groupBy(*PAIR).agg(F.sum("n").alias("_all"))
    levels = ranked.join(totals, PAIR).select(
        *PAIR,
        F.col("x_less").cast("bigint").alias("x"),
        F.col("y_less").cast("bigint").alias("y"),
        "n",
        F.explode(F.sequence(F.lit(0), bits)).alias("level"),
    )
    side = F.expr("shiftright(x, level) & 1")
    sides = levels.select(*PAIR, "level", F.expr("shiftright(x, level + 1)").alias("prefix"), "y", "n", side.alias("side"))
    group = [*PAIR, "level", "prefix"]
    per_y = stage(
        sides.groupBy(*group, "y").agg(
            F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("low"),
            F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("high"),
        ),
        "levels",
    )
    running = running_total(per_y, group, "y", "low", "_low_upto")
    return running.groupBy(*PAIR).agg(
        F.sum(F.col("high") * (F.col("_low_upto") - F.col("low"))).alias("concordant")
    )


def _kendall(ranked: DataFrame) -> DataFrame:
    both = ranked.groupBy(*PAIR).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("bigint").alias("_xy0")
    )
    table = (
        both.join(_tie_sums(ranked, "metric_small", "x_n", "x"), PAIR)
        .join(_tie_sums(ranked, "metric_large", "y_n", "y"), PAIR)
        .join(_concordant(ranked), PAIR)
    )
    total = F.col("n") * (F.col("n") - 1) / 2
    comparable = total - F.col("x0") - F.col("y0") + F.col("_xy0")
    table = table.withColumn("discordant", (comparable - F.col("concordant")).cast("bigint"))
    spread = F.sqrt((total - F.col("x0")).cast("double")) * F.sqrt((total - F.col("y0")).cast("double"))
    tau = (F.col("concordant") - F.col("discordant")) / F.nullif(spread, F.lit(0.0))
    return table.withColumn("kendall_tau", tau)


def kendall(merged: DataFrame, p_value: bool = True) -> DataFrame:
    """Tau-b per size pair with at least two common tokenizers."""
    return _kendall_columns(_kendall(_ranked(stage(merged, "merged"))), p_value)


def _kendall_columns(table: DataFrame, p_value: bool) -> DataFrame:
    table = table.filter(F.col("n") >= 2)
    columns = [*PAIR, "n", "concordant", "discordant", "kendall_tau"]
    if p_value:
        names = ("n", "concordant", "discordant", "x0", "x1", "x2", "y0", "y1", "y2")
        table = table.withColumn("kendall_p", kendall_p_udf(F.struct(*names)))
        columns.append("kendall_p")
    return table.select(*columns)


def correlation_summary(
    results: DataFrame,
    metric: str = "bits_per_byte",
    size: str = "model_size",
    tokenizer: str = "tokenizer_path",
    string_order: bool = False,
    p_value: bool = True,
) -> DataFrame:
    """Seed means, all size pairs, both correlations; no driver loop."""
    merged = stage(merge_sizes(seed_means(results, size, tokenizer, metric), string_order), "merged")
    ranked = _ranked(merged)
    rho = _spearman(ranked).filter(F.col("n") >= 2)
    if p_value:
        rho = rho.withColumn("spearman_p", spearman_p_udf("spearman_rho", "n"))
    tau = _kendall_columns(_kendall(ranked), p_value)
    out = rho.join(tau.drop("n", "concordant", "discordant"), PAIR)
    columns = ["spearman_rho", "kendall_tau"]
    if p_value:
        columns = ["spearman_rho", "spearman_p", "kendall_tau", "kendall_p"]
    return out.select(*PAIR, *columns, F.lit(metric).alias("metric"))


def metric_range(results: DataFrame, metrics: list[str]) -> DataFrame:
    return results.agg(*[f(m).alias(f"{f.__name__}_{m}") for m in metrics for f in (F.min, F.max)])
