"""Pruning of a merge vocabulary by what its tokens tell of their contexts.

Tokens have skip-gram vectors. A token's loss is what the fit to its contexts
would lose if its parts stood in its place. The vocabulary shrinks in several
cuts. Each cut removes the tokens of the least loss, segments only the texts
that hold one of them anew, adds the signed differences of their pair counts to
the counts before, and fits the vectors on from the old ones, as contexts and
parts have changed.

Corpus work is one scan of the encoded texts per cut, whose differences are
summed in each task before the shuffle. The fit runs on the table of distinct
pairs. Vectors are a row per token, bounded by the vocabulary; they are sent to
the tasks once a step, and one gradient row per token comes back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.learn.flat import in_parts, together
from lingua_spark.learn.model import MergeModel
from lingua_spark.runtime import stage, unstage


@dataclass(frozen=True)
class ContextOptions:
    """``window``: places to either side; ``cuts``: steps from the first to the
    last vocabulary; ``first_steps`` and ``next_steps``: gradient steps before
    the first and before each later cut; ``negatives``: contexts drawn against
    each token, together weighted like ``negative_weight`` times its pairs."""

    dimension: int = 16
    window: int = 3
    cuts: int = 4
    first_steps: int = 12
    next_steps: int = 4
    rate: float = 0.3
    negatives: int = 32
    negative_weight: float = 1.0
    seed: int = 42


TOKENS = 1 << 20  # tokens of texts taken at once


@dataclass
class Row:
    """Texts side by side: numbers of their tokens, and the text of each."""

    names: list[str]
    ids: np.ndarray
    text: np.ndarray

    def spelled(self, spelling: dict[str, list[str]]) -> Row:
        """The same texts with some tokens replaced by others."""
        number = {t: i for i, t in enumerate(self.names)}
        parts = [[number.setdefault(s, len(number)) for s in spelling.get(t, (t,))] for t in self.names]
        sizes = np.array([len(p) for p in parts], np.int64)
        table, first = np.array([s for p in parts for s in p], np.int64), np.cumsum(sizes) - sizes
        many = sizes[self.ids]
        inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return Row(list(number), table[np.repeat(first[self.ids], many) + inside], np.repeat(self.text, many))

    def holding(self, tokens: set[str]) -> Row:
        """Only the texts that hold one of the tokens."""
        wanted = np.array([t in tokens for t in self.names], bool)
        texts = np.zeros(self.text[-1] + 1 if len(self.text) else 0, bool)
        texts[self.text[wanted[self.ids]]] = True
        kept = texts[self.text]
        return Row(self.names, self.ids[kept], self.text[kept])

    def pairs(self, window: int, sign: int = 1) -> pa.Table:
        """(token, context, n): pairs of a token and one at most ``window`` places
        behind it."""
        k = max(len(self.names), 1)
        near = [np.flatnonzero(self.text[: -i] == self.text[i:]) for i in range(1, window + 1)]
        codes = np.concatenate([self.ids[at] * k + self.ids[at + i] for i, at in enumerate(near, 1)] or [self.ids[:0]])
        found, n = np.unique(codes, return_counts=True)
        names = pa.array(self.names, pa.string())
        columns = [names.take(pa.array(found // k)), names.take(pa.array(found % k)), pa.array(sign * n, pa.int64())]
        return pa.table(columns, names=["token", "context", "n"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Row]:
    """The texts of a column of tokens, about TOKENS tokens at a time."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy().astype(np.int64)
        for part in in_parts(batch, lengths, TOKENS):
            column = part.column(0)
            coded = column.flatten().dictionary_encode()
            many = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
            yield Row(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(many)), many))


def counted(tokens: DataFrame, column: str, of_row) -> DataFrame:
    """Sums of the pairs that ``of_row`` finds in texts, added up in the tasks first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (table for row in rows_of(batches) for table in of_row(row))
        return together(tables, ["token", "context"], "n")

    parts = tokens.select(column).mapInArrow(sums, "token string, context string, n bigint")
    return parts.groupBy("token", "context").agg(F.sum("n").alias("n"))


def both_ways(ahead: DataFrame) -> DataFrame:
    """Each pair in both directions, summed; pairs that cancelled out go."""
    both = ahead.unionByName(ahead.select(F.col("context").alias("token"), F.col("token").alias("context"), "n"))
    return both.groupBy("token", "context").agg(F.sum("n").alias("n")).filter("n <> 0")


def context_pairs(tokens: DataFrame, window: int = 3, column: str = "tokens") -> DataFrame:
    """(token, context, n) within ``window`` places of each other."""
    return both_ways(counted(tokens, column, lambda row: [row.pairs(window)]))


def changed_pairs(tokens: DataFrame, before: dict, after: dict, window: int, column: str = "tokens") -> DataFrame:
    """Signed differences of the pair counts between two segmentations.

    ``before`` and ``after`` give the emitted tokens of removed ones. Texts
    without a token that the two spell differently are passed over.
    """
    new = {t: spelled for t, spelled in after.items() if before.get(t) != spelled}
    shared = tokens.sparkSession.sparkContext.broadcast((before, after, set(new)))

    def differences(row: Row) -> list[pa.Table]:
        old, now, touched = shared.value
        row = row.holding(touched)
        return [row.spelled(old).pairs(window, -1), row.spelled(now).pairs(window)]

    return both_ways(counted(tokens, column, differences))


def first_vector(token: str, dimension: int, seed: int, side: str) -> np.ndarray:
    """Small values that only the token and the seed decide."""
    digest = hashlib.md5(f"{seed}:{side}:{token}".encode(), usedforsecurity=False).digest()
    return (np.random.default_rng(int.from_bytes(digest[:8], "big")).random(dimension) - 0.5) / dimension


def log_sigmoid(x: np.ndarray) -> np.ndarray:
    return -np.logaddexp(0.0, -x)


class Vectors:
    """Token and context vectors, with the sums of squares that scale steps."""

    def __init__(self, names: list[str], options: ContextOptions, old: Vectors | None = None):
        self.names, self.options = names, options
        self.place = {t: i for i, t in enumerate(names)}
        d, seed = options.dimension, options.seed
        self.v = np.array([[first_vector(t, d, seed, side) for t in names] for side in ("token", "context")])
        self.squares = np.full_like(self.v, 1e-8)
        if old is not None:
            both = [t for t in names if t in old.place]
            here, there = [self.place[t] for t in both], [old.place[t] for t in both]
            self.v[:, here], self.squares[:, here] = old.v[:, there], old.squares[:, there]

    def move(self, gradient: np.ndarray) -> None:
        self.squares += gradient**2
        self.v += self.options.rate * gradient / np.sqrt(self.squares)


def pair_gradient(v: np.ndarray, token: np.ndarray, context: np.ndarray, n: np.ndarray, sign: int) -> np.ndarray:
    """Gradient of the sum of n * log sigmoid(sign * token . context)."""
    u, w = v[0, token], v[1, context]
    slope = sign * n / (1.0 + np.exp(np.clip(sign * (u * w).sum(1), -60, 60)))
    out = np.zeros_like(v)
    np.add.at(out[0], token, slope[:, None] * w)
    np.add.at(out[1], context, slope[:, None] * u)
    return out


def drawn(counts: np.ndarray, options: ContextOptions, step: int) -> np.ndarray:
    """Numbers of the contexts drawn for each token, by smoothed frequency."""
    share = np.cumsum(counts**0.75)
    draws = np.random.default_rng([options.seed, step]).random((len(counts), options.negatives)) * share[-1]
    return np.minimum(np.searchsorted(share, draws, side="right"), len(counts) - 1)


def fit_vectors(pairs: DataFrame, options: ContextOptions, steps: int, old: Vectors | None = None) -> Vectors:
    """Gradient steps over all pairs, from the vectors ``old`` where known."""
    spark = pairs.sparkSession
    totals = pairs.groupBy("token").agg(F.sum("n").alias("n"))
    sizes = {r["token"]: r["n"] for r in totals.collect()}  # a row per token
    vectors = Vectors(sorted(sizes), options, old)
    counts = np.array([sizes[t] for t in vectors.names], float)
    d = options.dimension
    for step in range(steps if len(counts) else 0):
        shared = spark.sparkContext.broadcast((vectors.v, vectors.place))

        def gradients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, place = shared.value
            total = np.zeros_like(v)
            for f in frames:
                token, context = f["token"].map(place).to_numpy(), f["context"].map(place).to_numpy()
                total += pair_gradient(v, token, context, f["n"].to_numpy(float), 1)
            side, used = np.nonzero(total.any(2))
            yield pd.DataFrame({"side": side, "at": used, "g": list(total[side, used])})

        rows = pairs.mapInPandas(gradients, "side int, at int, g array<double>").groupBy("side", "at")
        sums = rows.agg(F.array(*[F.sum(F.get("g", i)) for i in range(d)]).alias("g")).collect()
        gradient = np.zeros_like(vectors.v)
        for r in sums:
            gradient[r["side"], r["at"]] = r["g"]
        shared.destroy()
        against = drawn(counts, options, step)
        for column in against.T:
            weight = options.negative_weight * counts / options.negatives
            gradient += pair_gradient(vectors.v, np.arange(len(counts)), column, weight, -1)
        vectors.move(gradient / counts.mean())
    return vectors


def losses_of(pairs: DataFrame, vectors: Vectors, parts: dict[str, list[str]]) -> DataFrame:
    """(token, loss, n) of the tokens with parts: the sum over contexts of
    n * (log s(token, context) - mean of log s(part, context)). A part that
    never stands alone has no vector and counts as a neutral fit."""
    known = {t: p for t, p in parts.items() if t in vectors.place}
    shared = pairs.sparkSession.sparkContext.broadcast((vectors.v, vectors.place, known))

    def gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, place, parts_of = shared.value
        for frame in frames:
            frame = frame[frame["token"].isin(parts_of.keys())]
            rows = []
            for token, group in frame.groupby("token"):
                w = v[1, group["context"].map(place).to_numpy()]
                n = group["n"].to_numpy(float)
                fits = [
                    log_sigmoid(w @ v[0, place[p]]) if p in place else np.full(len(w), np.log(0.5)) for p in parts_of[token]
                ]
                gap = log_sigmoid(w @ v[0, place[token]]) - np.mean(fits, axis=0)
                rows.append((token, float((n * gap).sum()), int(n.sum())))
            yield pd.DataFrame(rows, columns=["token", "loss", "n"])

    rows = pairs.mapInPandas(gaps, "token string, loss double, n bigint")
    return rows.groupBy("token").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))


def prune(
    model: MergeModel, df: DataFrame, target: int, text: str = "text", options: ContextOptions | None = None
) -> tuple[MergeModel, dict[str, float]]:
    """``model`` cut to ``target`` tokens, and the last losses of those kept.

    Base symbols stay. Removed tokens are merged over but spelled by their
    parts, so the model goes on encoding. Tokens that no text holds have no
    loss and go first; ties go by the token.
    """
    o = options or ContextOptions()
    base = set(model.alphabet)
    surplus = max(0, min(model.vocab_size - target, len([t for t in model.tokens if t not in base])))
    encoded = stage(model.encode(df.select(text), text, "tokens", as_tokens=True).select("tokens"), "encoded")
    pairs = stage(context_pairs(encoded, o.window), "pairs")
    spelled, vectors, kept, parents = model.expansion(), None, {}, model.parents()
    for cut in range(max(1, o.cuts)):
        vectors = fit_vectors(pairs, o, o.next_steps if cut else o.first_steps, vectors)
        now = replace(model, hidden=set(model.hidden) | set(spelled))
        expansion = now.expansion()
        merged = [t for t in now.tokens if t not in base]
        parts = {t: [s for p in parents[t] for s in expansion.get(p, [p])] for t in merged}
        found = {r["token"]: r["loss"] for r in losses_of(pairs, vectors, parts).collect()}
        kept = {t: found.get(t, 0.0) for t in merged}
        gone = surplus * (cut + 1) // max(1, o.cuts) - surplus * cut // max(1, o.cuts)
        order = sorted(merged, key=lambda t: (t in found, kept[t], t))
        if not gone:
            continue
        for t in order[:gone]:
            del kept[t]
        after = replace(model, hidden=set(now.hidden) | set(order[:gone])).expansion()
        if cut + 1 < o.cuts:
            change = changed_pairs(encoded, spelled, after, o.window)
            summed = pairs.unionByName(change).groupBy("token", "context").agg(F.sum("n").alias("n"))
            before, pairs = pairs, stage(summed.filter("n <> 0"), "pairs")
            unstage(before)
        spelled = after
    return replace(model, hidden=set(model.hidden) | set(spelled)), kept


def context_losses(model: MergeModel, df: DataFrame, text: str = "text", options: ContextOptions | None = None) -> DataFrame:
    """What the skip-gram fit loses if a token is replaced by its two parts."""
    o = options or ContextOptions()
    encoded = stage(model.encode(df.select(text), text, "tokens", as_tokens=True).select("tokens"), "encoded")
    pairs = stage(context_pairs(encoded, o.window), "pairs")
    expansion, emitted = model.expansion(), set(model.tokens)
    parts = {t: [s for p in lr for s in expansion.get(p, [p])] for t, lr in model.parents().items() if t in emitted}
    return losses_of(pairs, fit_vectors(pairs, o, o.first_steps), parts)


def sage_prune(model: MergeModel, df: DataFrame, target: int, text: str = "text", **options) -> DataFrame:
    """The vocabulary reduced to ``target`` tokens (special ones counted but not
    listed), with the losses of the merged ones."""
    pruned, losses = prune(model, df, target, text, ContextOptions(**options))
    rows = [(t, losses.get(t)) for t in pruned.tokens]
    return model.spark.createDataFrame(rows, "token string, loss double")
