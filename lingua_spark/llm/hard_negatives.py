"""Hard negatives of anchors by slots of scores.

Scores are inner products of quantized vectors. An anchor's positives are its
nearest rows of the same label; a positive of score p asks for the best rows of
other labels whose score lies between a lower and an upper share of p. The
windows of an anchor's positives overlap, but each is cut at its upper end only
by its own limit. So the limits of an anchor, in falling order, split all scores
into disjoint slots:

1. every task keeps, per anchor and slot, the first ``Mining.negatives`` rows it
   meets; a shuffle of these few keeps the first of all tasks;
2. the rows under a limit are those of its slot, followed by those under the
   next lower limit, so going through the slots from the lowest up, each merge
   of two short lists answers the next window; its lower limit then cuts the
   tail.

A row thus is looked at once per anchor, however many windows it is in, and
what leaves a task is bounded by anchors x slots x negatives.

Anchors are the queries of a search against all rows. They are taken in blocks
of ``Mining.anchors`` (the size of what is sent to the tasks), one pass over the
quantized table each. Inside a task, scores of a block of rows are one matrix
product, in the narrowest float type in which every product is exact.

Defined cases: rows with a null key or label, a null vector, or a null or
non-finite entry, and rows not as long as most (of two lengths equally frequent,
the longer) have no part; an entry beyond ``LARGEST`` counts as that; an anchor
is a row, not a key: of rows with equal keys each is answered, and is among the
other rows of the others; ties go by key, then by row; without anchors,
positives or negatives there are no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.llm.common import stage
from lingua_spark.llm.whitening import usable, usual_length

#: Largest entry of a quantized vector, so that scores fit a long.
LARGEST = 1 << 26
#: Rows and anchors whose scores are one matrix product.
ROWS, BESIDE = 2048, 512


@dataclass(frozen=True)
class Mining:
    """A negative's score lies between ``low`` and ``high`` hundredths of its
    positive's. ``anchors``: how many are sent to the tasks at once."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90
    scale: float = 256
    anchors: int = 8192


class Best:
    """The first ``k`` (score falling, key, row) of each of some groups."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.scores = np.full((groups, k), np.iinfo(np.int64).min)
        self.keys = np.full((groups, k), np.iinfo(np.int64).max)
        self.rows = np.full((groups, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        """The score that a further row must reach, by group."""
        return self.scores[:, -1]

    def offer(self, group: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        touched, place = np.unique(group, return_inverse=True)
        held = np.repeat(np.arange(len(touched)), self.k)
        place = np.concatenate([held, place])
        score = np.concatenate([self.scores[touched].ravel(), score])
        key = np.concatenate([self.keys[touched].ravel(), key])
        row = np.concatenate([self.rows[touched].ravel(), row])
        order = np.lexsort((row, key, ~score, place))  # ~ turns the order around without overflow
        place = place[order]
        start = np.searchsorted(place, np.arange(len(touched)))
        first = np.arange(len(place)) - start[place] < self.k
        chosen = order[first]
        self.scores[touched] = score[chosen].reshape(-1, self.k)
        self.keys[touched] = key[chosen].reshape(-1, self.k)
        self.rows[touched] = row[chosen].reshape(-1, self.k)

    def filled(self) -> tuple[np.ndarray, ...]:
        group, at = np.nonzero(self.rows != np.iinfo(np.int64).max)
        return group, self.scores[group, at], self.keys[group, at], self.rows[group, at]


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """All inner products, in a type that holds every partial sum."""
    if not (len(left) and len(right)):
        return np.zeros((len(left), len(right)), np.int64)
    bound = int(np.abs(left).max()) * int(np.abs(right).max()) * left.shape[1]
    if bound < 1 << 53:
        kind = np.float32 if bound < 1 << 24 else np.float64
        return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
    return left @ right.T


@dataclass
class Block:
    """Some anchors as arrays."""

    rows: np.ndarray
    keys: np.ndarray
    labels: list
    vectors: np.ndarray


QUANTIZED = "row bigint, key bigint, label string, vector array<bigint>"


def quantized(df: DataFrame, mining: Mining, key: str, label: str, vector: str) -> DataFrame | None:
    """Numbered rows that take part, as whole numbers; None if there are none."""
    dim = usual_length(df, vector)
    if dim is None:
        return None
    bound = F.lit(float(LARGEST))
    entries = F.transform(
        vector, lambda c: F.floor(F.greatest(-bound, F.least(bound, c.cast("double") * mining.scale))).cast("bigint")
    )
    return stage(
        df.filter(usable(vector, dim) & F.col(key).isNotNull() & F.col(label).isNotNull()).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(key).cast("bigint").alias("key"),
            F.col(label).cast("string").alias("label"),
            entries.alias("vector"),
        ),
        "quantized",
    )


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, keys, labels and vectors of a batch, ``ROWS`` at a time."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
        yield (
            part.column("row").to_numpy(),
            part.column("key").to_numpy(),
            np.array(part.column("label").to_pylist(), object),
            flat.reshape(part.num_rows, -1),
        )


def tiles(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple]:
    """Scores of some anchors (from ``low`` on) with some rows, and whether
    their labels agree."""
    codes = {v: i for i, v in enumerate(dict.fromkeys(block.labels))}
    own = np.array([codes[v] for v in block.labels])
    for batch in batches:
        for rows, keys, labels, vectors in arrays(batch):
            theirs = np.array([codes.get(v, -1) for v in labels])
            for low in range(0, len(own), BESIDE):
                some = slice(low, low + BESIDE)
                yield low, exact(block.vectors[some], vectors), own[some, None] == theirs, rows, keys


FOUND = "anchor bigint, slot int, score bigint, key bigint, row bigint"


def leave(anchor, slot, score, key, row) -> pa.RecordBatch:
    columns = [pa.array(anchor, pa.int64()), pa.array(slot, pa.int32()), *(pa.array(c, pa.int64()) for c in (score, key, row))]
    return pa.RecordBatch.from_arrays(columns, names=["anchor", "slot", "score", "key", "row"])


def first_of(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each anchor and slot over all tasks, numbered."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "key", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def positives_of(rows: DataFrame, block, k: int) -> DataFrame:
    """The first ``k`` other rows of each anchor's label; ``block`` is broadcast."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = block.value
        best = Best(len(sent.rows), k)
        for low, scores, same, numbers, keys in tiles(batches, sent):
            wanted = same & (numbers[None, :] != sent.rows[low : low + BESIDE, None])
            wanted &= scores >= best.worst()[low : low + BESIDE, None]
            a, r = np.nonzero(wanted)
            best.offer(a + low, scores[a, r], keys[r], numbers[r])
        group, score, key, row = best.filled()
        yield leave(sent.rows[group], np.zeros(len(group), np.int32), score, key, row)

    return first_of(rows.mapInArrow(search, FOUND), k)


def negatives_by_slot(rows: DataFrame, block, limits, k: int) -> DataFrame:
    """The first ``k`` rows of other labels in each slot of each anchor.

    ``limits`` is broadcast: upper limits by anchor and slot, falling, those
    without a slot at the smallest long, and the least score of any window.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, (upper, least) = block.value, limits.value
        slots = upper.shape[1]
        best = [Best(len(sent.rows), k) for _ in range(slots)]
        for low, scores, same, numbers, keys in tiles(batches, sent):
            some = slice(low, low + BESIDE)
            for slot in range(slots):
                # a slot reaches down to the next limit or to where no window goes
                below = upper[some, slot + 1] if slot + 1 < slots else np.full(len(scores), np.iinfo(np.int64).min)
                floor = np.maximum(np.maximum(below + 1, least[some]), best[slot].worst()[some])
                a, r = np.nonzero((scores <= upper[some, slot, None]) & (scores >= floor[:, None]) & ~same)
                best[slot].offer(a + low, scores[a, r], keys[r], numbers[r])
        for slot in range(slots):
            group, score, key, row = best[slot].filled()
            yield leave(sent.rows[group], np.full(len(group), slot, np.int32), score, key, row)

    return first_of(rows.mapInArrow(search, FOUND), k)


def answers(positives: DataFrame, slots: DataFrame, mining: Mining) -> DataFrame:
    """Windows answered by merging slots from the lowest up, per anchor.

    ``positives`` has (anchor, score, key, row, rank, slot, low); at most
    ``positives`` x ``negatives`` short rows meet per anchor.
    """
    listed = slots.groupBy("anchor", "slot").agg(
        F.sort_array(F.collect_list(F.struct("rank", "key", "score"))).alias("found")
    )
    lists = listed.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "found"))).alias("by_slot"))
    kind = "struct<rank:int,key:bigint,score:bigint>"
    none = F.expr(f"cast(array() as array<{kind}>)")
    # from the lowest slot up: what is under a limit is its slot, then what is under the next
    under = F.aggregate(
        F.sequence(F.lit(mining.positives - 1), F.lit(0), F.lit(-1)),
        F.expr(f"cast(array() as array<array<{kind}>>)"),
        lambda done, slot: F.concat(
            F.array(
                F.slice(
                    F.concat(F.coalesce(F.try_element_at("by_slot", slot), none), F.coalesce(F.get(done, F.lit(0)), none)),
                    1,
                    mining.negatives,
                )
            ),
            done,
        ),
    )
    merged = lists.withColumn("under", under).select("anchor", "under")
    window = F.filter(F.get("under", F.col("slot")), lambda n: n["score"] >= F.col("low"))
    return (
        positives.join(merged, "anchor")
        .select("anchor_id", F.col("key").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(window).alias("at", "n"))
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("n.key").alias("negative_id"),
            "positive_score",
            F.col("n.score").alias("negative_score"),
        )
    )


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def anchor_blocks(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors packed into rows of at most ``size`` of them."""
    n = anchors.count()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # one partition holds about ``size`` anchors
        if not held:
            return
        table = pa.Table.from_batches(held)
        each = -(-table.num_rows // -(-table.num_rows // size))  # blocks of equal size
        for at in range(0, table.num_rows, each):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table.slice(at, each))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["raw"])

    dealt = anchors.repartition(max(1, -(-n // size)))
    return stage(dealt.mapInArrow(pack, "raw binary").withColumn("block", F.monotonically_increasing_id()), "anchors")


def unpack(raw: bytes) -> Block:
    batch = pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches()[0]
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return Block(
        batch.column("row").to_numpy(),
        batch.column("key").to_numpy(),
        batch.column("label").to_pylist(),
        flat.reshape(batch.num_rows, -1),
    )


def mine(
    df: DataFrame, anchors: Column, mining: Mining = Mining(), key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """Hard negatives for each positive of each anchor.

    ``anchors`` is a condition on ``key`` (named so in the condition). A row per
    anchor, positive and negative: ``anchor_id``, ``positive_id``, ``rank``,
    ``negative_id``, ``positive_score``, ``negative_score``.
    """
    spark = df.sparkSession
    rows = quantized(df, mining, key, label, vector)
    if rows is None:
        return spark.createDataFrame([], RESULT)
    chosen = rows.withColumn(key, F.col("key")).filter(anchors).select("row", "key", "label", "vector")
    blocks = anchor_blocks(chosen, mining.anchors)
    numbers = [r["block"] for r in blocks.select("block").orderBy("block").collect()]
    out = None
    for number in numbers:
        sent = unpack(bytes(blocks.filter(F.col("block") == number).first()["raw"]))
        found = _mine_block(rows, sent, mining)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], RESULT) if out is None else out


def _mine_block(rows: DataFrame, block: Block, mining: Mining) -> DataFrame:
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(block)
    nearest = stage(positives_of(rows, sent, mining.positives), "positives")
    # windows in whole scores; those that hold none are left out
    windows = nearest.select(
        "anchor",
        "score",
        "key",
        "rank",
        F.expr(f"cast(floor(score * {mining.high}BD / 100) as bigint)").alias("high"),
        F.expr(f"cast(ceil(score * {mining.low}BD / 100) as bigint)").alias("low"),
    ).filter("low <= high")
    place = F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("high"))) - 1
    windows = stage(windows.withColumn("slot", place), "windows")
    upper = np.full((len(block.rows), mining.positives), np.iinfo(np.int64).min)
    least = np.full(len(block.rows), np.iinfo(np.int64).max)
    at = {int(r): i for i, r in enumerate(block.rows)}
    for anchor, slot, top, low in windows.groupBy("anchor", "slot").agg(F.max("high"), F.min("low")).collect():
        i = at[anchor]
        upper[i, slot], least[i] = top, min(least[i], low)
    limits = spark.sparkContext.broadcast((upper, least))
    slots = stage(negatives_by_slot(rows, sent, limits, mining.negatives), "slots")
    keys = spark.createDataFrame([(int(r), int(k)) for r, k in zip(block.rows, block.keys)], "anchor bigint, anchor_id bigint")
    return answers(windows.join(keys, "anchor"), slots, mining)


__all__ = ["Mining", "mine"]
