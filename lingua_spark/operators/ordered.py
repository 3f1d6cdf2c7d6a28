"""Order-dependent operators without one-task windows.

Rows have no order in Spark, so each operator takes an order: a column of any
sortable type or several, nulls first. ``with_key`` makes it a total order by
adding tie-breakers. The keys' range is cut into blocks at sampled quantiles. A
group's rows then spread over the blocks: sums per (group, block) are
pre-aggregated, the few block sums are accumulated, and only then do windows run
inside one (group, block). A group holding a third of all rows thus never meets
in one task, and neither does an order value that many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, StructType, VariantType

from lingua_spark.runtime import stage

KEY = "_key"
PER_BLOCK = 32  # sampled rows per block


def with_key(df: DataFrame, order: str | list[str], ties: list[str] | None = None) -> DataFrame:
    """``df`` with its total order as the struct column ``_key``.

    Rows with equal order values follow the columns ``ties``; without these the
    hash of all columns, so that only identical rows stay tied. A cheap unique
    column (a file's row index) saves reading all columns for that.
    """
    columns = [order] if isinstance(order, str) else list(order)
    if ties is None:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
        last = [F.xxhash64(*[F.col(f"`{c}`") for c in plain])]
    else:
        last = [F.col(c) for c in ties]
    parts = [F.col(c) for c in columns] + last
    return df.withColumn(KEY, F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)]))


def block_bounds(df: DataFrame, order: str, blocks: int | None = None) -> list:
    """At most ``blocks - 1`` cut points of the order column.

    Quantiles of a sample of fixed size per block, drawn by hash so that only
    its size reaches the driver. Bad cut points would cost balance, never
    correctness.
    """
    if blocks is None:
        blocks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if blocks <= 1:
        return []
    sample = (
        df.select(F.col(order).alias("k"), F.xxhash64(F.col(order), F.monotonically_increasing_id()).alias("h"))
        .orderBy("h")
        .limit(blocks * PER_BLOCK)
    )
    # sorted by Spark: its order of nulls, strings and structs is what counts
    values = [row["k"] for row in sample.orderBy("k").collect()]
    cuts = [values[len(values) * i // blocks] for i in range(1, blocks)] if values else []
    return [c for i, c in enumerate(cuts) if c is not None and (i == 0 or c != cuts[i - 1])]


def literal(value, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    return F.lit(value).cast(kind)


def block_of(order: str, bounds: list, kind: DataType | None = None) -> Column:
    """Number of bounds at or below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    table = F.array(*[literal(b, kind) if kind else F.lit(b) for b in bounds])
    low = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(bounds)) & (F.try_element_at(table, low + step) <= F.col(order)),
            low + step,
        ).otherwise(low),
    )
    return low


def _blocked(df: DataFrame, order: str, bounds: list) -> DataFrame:
    return df.withColumn("_block", block_of(order, bounds, df.schema[order].dataType))


def _offsets(blocked: DataFrame, group: list[str], value: Column) -> DataFrame:
    """Per (group, block): its sum and the sum of the group's earlier blocks."""
    sums = blocked.groupBy(*group, "_block").agg(F.sum(value).alias("_sum"))
    return sums.withColumn("_before", F.coalesce(F.sum("_sum").over(_earlier_blocks(group)), F.lit(0)))


def _earlier_blocks(group: list[str]):
    return Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def running_total(
    df: DataFrame,
    group: list[str],
    order: str,
    value: Column | str | int = 1,
    out: str = "running",
    bounds: list | None = None,
    ties: list[str] | None = None,
) -> DataFrame:
    """Running sum of ``value`` within the group, including the row itself.

    ``df`` is read twice (block sums, then rows); stage it if it is costly.
    """
    value = F.lit(value) if isinstance(value, int) else F.col(value) if isinstance(value, str) else value
    bounds = block_bounds(df, order) if bounds is None else bounds
    blocked = _blocked(df, order, bounds)
    offsets = _offsets(blocked, group, value).drop("_sum")
    inside = (
        Window.partitionBy(*group, "_block")
        .orderBy(order, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.join(offsets, [*group, "_block"])
        .withColumn(out, F.col("_before") + F.sum(value).over(inside))
        .drop("_block", "_before")
    )


def position(
    df: DataFrame, group: list[str], order: str, out: str = "position", bounds: list | None = None
) -> DataFrame:
    """1-based place of the row in its group."""
    return running_total(df, group, order, F.lit(1).cast("bigint"), out, bounds)


def first_crossing(
    df: DataFrame,
    group: list[str],
    order: str,
    value: Column,
    targets: DataFrame,
    bounds: list,
) -> DataFrame:
    """Per group the first row whose running sum exceeds the group's ``target``.

    ``cut`` is its order value, ``tied`` the rows of that value before it,
    ``held`` all rows of that value, ``rows_before`` all rows before it. Only
    the block where the crossing lies is sorted; groups that never cross are
    absent.
    """
    blocked = _blocked(df, order, bounds).withColumn("_value", value)
    earlier = _earlier_blocks(group)
    sums = blocked.groupBy(*group, "_block").agg(F.sum("_value").alias("_sum"), F.count("*").alias("_rows"))
    sums = sums.withColumns(
        {
            "_before": F.coalesce(F.sum("_sum").over(earlier), F.lit(0)),
            "_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)),
        }
    )
    crossing = stage(
        sums.join(targets.select(*group, "target"), group)
        .filter((F.col("_before") <= F.col("target")) & (F.col("_before") + F.col("_sum") > F.col("target")))
        .select(*group, "_block", "_before", "_rows_before", "target"),
        "crossing",
    )
    sorted_rows = Window.partitionBy(*group).orderBy(order)
    inside = sorted_rows.rowsBetween(Window.unboundedPreceding, 0)
    rows = blocked.join(crossing, [*group, "_block"])
    rows = rows.withColumns(
        {
            "_total": F.col("_before") + F.sum("_value").over(inside),
            "_place": F.row_number().over(sorted_rows),
            "_rank": F.rank().over(sorted_rows),
        }
    )
    first = F.struct("_place", "_rank", F.col("_rows_before").alias("_rows_before"), F.col(order).alias("cut"))
    over = rows.groupBy(*group).agg(F.min(F.when(F.col("_total") > F.col("target"), first)).alias("_first"))
    held = rows.groupBy(*group, "_rank").agg(F.count("*").alias("held"))
    found = over.select(*group, "_first.*").join(held, [*group, "_rank"])
    return found.select(
        *group,
        "cut",
        (F.col("_place") - F.col("_rank")).cast("bigint").alias("tied"),
        "held",
        (F.col("_rows_before") + F.col("_place") - 1).alias("rows_before"),
    )


def cut_at_rank(df: DataFrame, group: list[str], order: str, ranks: DataFrame, bounds: list) -> DataFrame:
    """Per group the order value of the row at the 1-based ``rank``, and how
    many of that value's ``held`` rows lie up to it (``tied``); groups with
    fewer rows are absent."""
    targets = ranks.select(*group, (F.col("rank") - 1).alias("target"))
    cuts = first_crossing(df, group, order, F.lit(1).cast("bigint"), targets, bounds)
    return cuts.select(*group, "cut", (F.col("tied") + 1).alias("tied"), "held")


def limit_of(cut: str, tied: str, held: str) -> Column:
    """A cut as one struct column."""
    return F.struct(F.col(cut).alias("cut"), F.col(tied).alias("tied"), F.col(held).alias("held"))


def up_to(limit: str) -> Column:
    """Whether a row with ``_key`` and ``_nth`` lies up to the limit."""
    return (F.col(KEY) < F.col(f"{limit}.cut")) | (
        (F.col(KEY) == F.col(f"{limit}.cut")) & (F.col("_nth") <= F.col(f"{limit}.tied"))
    )


def numbered(df: DataFrame, group: list[str], cuts: DataFrame, limits: list[str]) -> DataFrame:
    """``df`` (with ``_key``) joined with the groups' limits, and ``_nth``.

    ``_nth`` numbers identical rows. Only a limit that falls between identical
    rows needs it; then just the rows at that limit are shuffled and numbered,
    and all others stay a map-only job.
    """
    parts = [
        cuts.filter(f"{c}.tied > 0 and {c}.tied < {c}.held").select(*group, F.col(f"{c}.cut").alias("_at"))
        for c in limits
    ]
    split = parts[0]
    for part in parts[1:]:
        split = split.unionByName(part)
    joined = df.join(cuts, group, "left")
    between = split.distinct().collect()  # at most a few per group
    if not between:
        return joined.withColumn("_nth", F.lit(1).cast("bigint"))
    kind = df.schema[KEY].dataType
    at_limit = F.lit(False)
    for row in between:
        here = F.col(KEY) == literal(row["_at"], kind)
        for column in group:
            here = here & F.col(column).eqNullSafe(F.lit(row[column]))
        at_limit = at_limit | here
    at_limit = F.coalesce(at_limit, F.lit(False))
    same = stage(joined.filter(at_limit).withColumn("_id", F.monotonically_increasing_id()), "identical")
    counted = position(same, [*group, KEY], "_id", "_nth").drop("_id")
    return joined.filter(~at_limit).withColumn("_nth", F.lit(1).cast("bigint")).unionByName(counted)


__all__ = [
    "KEY",
    "block_bounds",
    "block_of",
    "cut_at_rank",
    "first_crossing",
    "limit_of",
    "numbered",
    "position",
    "running_total",
    "up_to",
    "with_key",
]
