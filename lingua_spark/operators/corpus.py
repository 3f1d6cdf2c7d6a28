"""Corpus building: proportions, byte budgets, splits, samples, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.functions.hashing import hash_uniform
from lingua_spark.functions.text import chunk_array, strip, utf8_bytes
from lingua_spark.operators.ordered import (
    KEY,
    block_bounds,
    cut_at_rank,
    first_crossing,
    limit_of,
    numbered,
    position,
    up_to,
    with_key,
)
from lingua_spark.runtime import stage


def lang_proportions(
    sizes: DataFrame, temperature: float = 5.0, cap: float = 0.5, lang: str = "lang", size: str = "size"
) -> DataFrame:
    """Sampling share per language: size^(1/T), normalised, capped once, the
    freed mass given to the others in proportion.

    Works on one row per language, so the global windows stay tiny.
    """
    every = Window.partitionBy()
    if temperature == 1:
        powered = F.col(size).cast("double")
    else:
        powered = F.pow(F.col(size).cast("double"), F.lit(1.0 / temperature))
    df = sizes.select(lang, size, powered.alias("_w"))
    df = df.withColumn("_p", F.col("_w") / F.sum("_w").over(every))
    df = df.withColumn("_any", F.max(F.col("_p") > cap).over(every))
    df = df.withColumn("_p", F.when(F.col("_p") > cap, F.lit(float(cap))).otherwise(F.col("_p")))
    free = F.col("_p") < cap
    df = df.withColumn("_left", 1.0 - F.sum(F.when(~free, F.col("_p")).otherwise(0.0)).over(every))
    df = df.withColumn("_free", F.sum(F.when(free, F.col("_w")).otherwise(0.0)).over(every))
    df = df.withColumn(
        "_p", F.when(F.col("_any") & free, F.col("_w") / F.col("_free") * F.col("_left")).otherwise(F.col("_p"))
    )
    df = df.withColumn("_sum", F.sum("_p").over(every))
    off = F.abs(F.col("_sum") - 1.0) > 1e-5 * F.greatest(F.col("_sum"), F.lit(1.0))
    return df.select(lang, size, F.when(off, F.col("_p") / F.col("_sum")).otherwise(F.col("_p")).alias("proportion"))


def byte_targets(proportions: DataFrame, total_gb: float, lang: str = "lang") -> DataFrame:
    target = F.floor(F.lit(float(total_gb)) * F.col("proportion") * F.lit(float(1024**3)))
    return proportions.select(lang, target.cast("bigint").alias("target_bytes"))


@dataclass
class SplitOptions:
    val_frac: float = 0.005
    test_frac: float = 0.005
    max_eval_rows: int = 3000
    min_lines_floor: int = 0
    seed: int = 42
    unlimited_at_zero: bool = True


def budget_split(
    df: DataFrame,
    targets: DataFrame,
    options: SplitOptions | None = None,
    lang: str = "lang",
    order: str | list[str] = "doc_id",
    text: str = "text",
    ties: list[str] | None = None,
    draw: str | None = None,
) -> DataFrame:
    """Byte budget with line floor and capped random train/val/test split.

    Per language, rows are taken in order until one would exceed the budget;
    if train then has fewer rows than the floor, further rows go to train.
    Before that point a row goes to val or test by its hash while these have
    room, a full val overflowing into test.

    All of this is decided by four limits per language (end of budget, end of
    floor, last val row, last test row). They are found on a narrow staged
    table; the texts themselves are then filtered and labelled in one map-only
    pass. Nulls come first in the order; rows with equal order values follow
    ``ties`` (the hash of all columns unless given). The hash that sends rows
    to val and test is that of ``draw``, the first order column unless given.
    """
    o = options or SplitOptions()
    group = [lang]
    draw = draw or (order if isinstance(order, str) else order[0])
    rows = with_key(df.filter(F.col(text).isNotNull()), order, ties)
    rows = rows.withColumn("_r", hash_uniform(draw, o.seed, "split"))
    narrow = stage(rows.select(lang, KEY, "_r", utf8_bytes(text, True).alias("bytes")), "budget")
    live = stage(
        targets.select(lang, "target_bytes").filter((F.col("target_bytes") > 0) | F.lit(o.min_lines_floor > 0)),
        "targets",
    )
    limited = live.filter(F.col("target_bytes") > 0) if o.unlimited_at_zero else live
    bounds = block_bounds(narrow, KEY)

    # 1. Rows before the first one over the budget.
    over = first_crossing(
        narrow, group, KEY, F.col("bytes"), limited.withColumnRenamed("target_bytes", "target"), bounds
    )
    over = over.select(lang, limit_of("cut", "tied", "held").alias("over"), "rows_before")
    totals = narrow.groupBy(lang).agg(F.count("*").alias("_all"))
    cuts = stage(
        live.join(totals, lang)
        .join(over, lang, "left")
        .select(lang, "target_bytes", "over", F.coalesce("rows_before", "_all").alias("inside")),
        "cuts",
    )

    # 2. Last val and last test row before it, and how many they are.
    inside = numbered(narrow.select(lang, KEY, "_r"), group, cuts.select(lang, "over"), ["over"])
    inside = inside.join(cuts.select(lang), lang, "left_semi")
    inside = inside.filter(F.col("over").isNull() | up_to("over")).select(lang, KEY, "_r", "_nth")
    none = F.lit(None).cast(cuts.schema["over"].dataType)
    cuts = cuts.withColumns({"val": none, "test": none, "n_val": F.lit(0), "n_test": F.lit(0)})
    n = o.max_eval_rows
    if n > 0 and o.val_frac > 0:
        cuts = _eval_cut(cuts, inside.filter(F.col("_r") < o.val_frac), "val", n, lang, bounds)
    if n > 0 and o.val_frac + o.test_frac > 0:
        # Identical rows share their draw, so a full val may end between them.
        tied = numbered(inside.drop("_nth"), group, cuts.select(lang, "val"), ["val"])
        past_val = F.col("val").isNotNull() & ~up_to("val")
        for_test = tied.filter(
            (F.col("_r") < o.val_frac + o.test_frac) & ((F.col("_r") >= o.val_frac) | past_val)
        )
        cuts = _eval_cut(cuts, for_test.select(lang, KEY), "test", n, lang, bounds)

    # 3. Rows over the budget that the floor still admits.
    missing = F.greatest(F.lit(0), F.lit(o.min_lines_floor) - (F.col("inside") - F.col("n_val") - F.col("n_test")))
    cuts = cuts.withColumn("rank", F.col("inside") + missing)
    if o.min_lines_floor > 0:
        ends = cuts.filter(F.col("over").isNotNull() & (F.col("rank") > F.col("inside")))
        ends = cut_at_rank(narrow, group, KEY, ends.select(lang, "rank"), bounds)
        ends = ends.select(lang, limit_of("cut", "tied", "held").alias("end"))
        cuts = cuts.join(ends, lang, "left")
    else:
        cuts = cuts.withColumn("end", none)
    cuts = stage(cuts.select(lang, "over", "end", "val", "test", "rank", "inside"), "cuts")

    # 4. One pass over the texts; only identical rows at a limit are numbered.
    known = rows.join(cuts.select(lang), lang, "left_semi")
    placed = numbered(known, group, cuts, ["over", "end", "val", "test"])
    under = F.col("over").isNull() | up_to("over")
    # Without an end row the floor lies past the data: everything is kept.
    floor = (F.col("rank") > F.col("inside")) & (F.col("end").isNull() | up_to("end"))
    room_val = F.lit(n > 0) & (F.col("val").isNull() | up_to("val"))
    room_test = F.lit(n > 0) & (F.col("test").isNull() | _test_room(o))
    split = (
        F.when(~under, "train")
        .when((F.col("_r") < o.val_frac) & room_val, "val")
        .when((F.col("_r") < o.val_frac + o.test_frac) & room_test, "test")
        .otherwise("train")
    )
    return placed.filter(under | floor).select(*df.columns, split.alias("split"))


def _test_room(o: SplitOptions):
    """Whether a row that did not go to val lies up to the last test row.

    Of identical rows the first ones may have gone to val; the test limit then
    counts the others.
    """
    at_both = (F.col(KEY) == F.col("val.cut")) & (F.col(KEY) == F.col("test.cut")) & (F.col("_r") < o.val_frac)
    later = (F.col(KEY) == F.col("test.cut")) & (F.col("_nth") - F.col("val.tied") <= F.col("test.tied"))
    return F.when(F.coalesce(at_both, F.lit(False)), later).otherwise(up_to("test"))


def _eval_cut(cuts: DataFrame, rows: DataFrame, name: str, n: int, lang: str, bounds: list) -> DataFrame:
    """Add the limit at the n-th of the candidate rows per language (null if
    there are fewer) and the number taken."""
    rows = stage(rows.select(lang, KEY), "eval")
    counts = rows.groupBy(lang).agg(F.least(F.count("*"), F.lit(n)).alias(f"n_{name}"))
    ranks = cuts.select(lang, F.lit(n).cast("bigint").alias("rank"))
    last = cut_at_rank(rows, [lang], KEY, ranks, bounds).select(lang, limit_of("cut", "tied", "held").alias(name))
    cuts = cuts.drop(f"n_{name}", name).join(counts, lang, "left").join(last, lang, "left")
    return stage(cuts.fillna({f"n_{name}": 0}), "cuts")


def corpus_counts(df: DataFrame, by: tuple[str, ...] = ("lang", "split"), text: str = "text") -> DataFrame:
    """Lines and bytes per group, with subtotals and a grand total."""
    sized = df.select(*by, utf8_bytes(text).alias("_b"))
    agg = sized.rollup(*by).agg(F.count("*").alias("lines"), F.sum("_b").alias("bytes"))
    return agg.select(
        *[F.coalesce(F.col(c), F.lit("TOTAL")).alias(c) for c in by],
        "lines",
        "bytes",
        F.round(F.col("bytes") / 1e9, 9).alias("gb"),
    )


def lang_order(df: DataFrame, lang: str = "lang", order: str = "doc_id", text: str = "text") -> DataFrame:
    """Languages by first appearance, with their non-blank texts counted; a
    language of blank texts only is still listed."""
    langs = df.groupBy(lang).agg(
        F.min(order).alias("first_seen"), F.count_if(strip(text) != "").alias("samples")
    )
    place = F.row_number().over(Window.orderBy("first_seen")) - 1
    return langs.select(lang, place.cast("bigint").alias("position"), "first_seen", "samples")


def first_bytes(df: DataFrame, num_bytes: int, order: str = "doc_id", text: str = "text") -> DataFrame:
    """The first texts in the given order whose UTF-8 bytes fit together.

    Only sizes and keys are shuffled; the texts are filtered map-only.
    """
    keyed = with_key(df.withColumn("_all", F.lit(0)), order)
    sizes = F.coalesce(F.octet_length(F.encode(text, "UTF-8")), F.lit(0)).cast("bigint")
    narrow = stage(keyed.select("_all", KEY, sizes.alias("_size")), "sizes")
    target = df.sparkSession.createDataFrame([(0, num_bytes)], "_all int, target bigint")
    cut = first_crossing(narrow, ["_all"], KEY, F.col("_size"), target, block_bounds(narrow, KEY))
    cut = stage(cut.select("_all", limit_of("cut", "tied", "held").alias("_limit")), "limit")
    if cut.isEmpty():
        return df
    return numbered(keyed, ["_all"], cut, ["_limit"]).filter(up_to("_limit")).select(*df.columns)


def tokenizer_sample(
    df: DataFrame,
    size_gb: float,
    temperature: float = 1.0,
    seed: int = 42,
    lang: str = "lang",
    order: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Bernoulli sample of each language with p = min(1, target/size).

    One aggregate over the sizes, then a map-only filter by hash. The draw is
    independent of the one that split the corpus.
    """
    sizes = df.groupBy(lang).agg(F.sum(utf8_bytes(text, True)).alias("size")).filter(F.col("size") > 0)
    shares = lang_proportions(sizes, temperature, 1.0, lang)
    target = F.floor(F.lit(float(size_gb)) * F.col("proportion") * F.lit(float(1024**3)))
    rates = stage(
        shares.select(lang, F.least(F.lit(1.0), target / F.col("size")).alias("_rate")).filter(F.col("_rate") > 0),
        "rates",
    )
    return df.join(rates, lang).filter(hash_uniform(order, seed, "sample") < F.col("_rate")).select(*df.columns)


def first_n_per_lang(
    df: DataFrame,
    n: int = 5000,
    lang: str = "lang",
    order: str | list[str] = "doc_id",
    text: str = "text",
    ties: list[str] | None = None,
) -> DataFrame:
    """The first n non-blank texts per language among the first 20·n rows.

    Both limits are found on narrow tables; the texts are filtered without a
    shuffle. Nulls come first in the order; rows with equal order values follow
    ``ties`` (the hash of all columns unless given).
    """
    keyed = with_key(df, order, ties).withColumn("_g", F.lit(0))
    narrow = stage(keyed.select("_g", KEY), "order")
    ranks = df.sparkSession.createDataFrame([(0, 20 * n)], "_g int, rank bigint")
    bounds = block_bounds(narrow, KEY)
    stop = cut_at_rank(narrow, ["_g"], KEY, ranks, bounds)
    stop = stage(stop.select("_g", limit_of("cut", "tied", "held").alias("stop")), "cuts")
    head = numbered(keyed, ["_g"], stop, ["stop"]).filter(F.col("stop").isNull() | up_to("stop")).drop("stop", "_nth")
    head = head.withColumn(lang, F.coalesce(F.col(lang), F.lit("unknown")))
    texts = head.withColumn(text, strip(text)).filter(F.col(text) != "")
    places = stage(texts.select(lang, KEY), "head")
    ranks = places.select(lang).distinct().withColumn("rank", F.lit(n).cast("bigint"))
    cuts = cut_at_rank(places, [lang], KEY, ranks, bounds)
    cuts = stage(cuts.select(lang, limit_of("cut", "tied", "held").alias("last")), "cuts")
    kept = numbered(texts, [lang], cuts, ["last"]).filter(F.col("last").isNull() | up_to("last"))
    return kept.select(*df.columns)


def modulo_dev_split(
    df: DataFrame,
    index: str | None = None,
    file: str = "language",
    order: str = "doc_id",
    text: str = "text",
    every: int = 100,
    max_chars: int = 8000,
) -> DataFrame:
    """Every ``every``-th row of a file goes to dev, blanks counted; all chunks
    of a row share its split.

    With ``index``, the 0-based row number in the file that the Parquet reader
    supplies, this is a map-only job. Without it rows are numbered by
    ``order``, which costs one shuffle.
    """
    if index is None:
        df = position(df, [file], order, "_place")
        number = F.col("_place") - 1
    else:
        number = F.col(index)
    split = F.when(number % every == 0, "dev").otherwise("train")
    texts = df.select(file, order, split.alias("split"), strip(text).alias(text))
    return texts.filter(F.col(text) != "").select(
        file, order, "split", F.posexplode(chunk_array(text, max_chars)).alias("chunk_no", text)
    )
