"""Words and whole texts as numbers of symbols, and merges on them.

The first 256 symbols are the bytes, so a text's codes are its UTF-8 bytes;
merged symbols follow. Codes after merges take two bytes, four beyond 65,536
symbols. They are arrays from the disk to the counts, and no symbol's letters
are read before the sums of a task are named.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.learn.flat import LETTERS, in_parts
from lingua_spark.learn.segmenting import Merges, Table
from lingua_spark.runtime import stage, stage_parts, unstage

BYTES = [f"{i:02X}" for i in range(256)]
UNROLLED = 16


def code_type(symbols: int) -> np.dtype:
    return np.dtype("<u2" if symbols <= 1 << 16 else "<u4")


@dataclass(frozen=True)
class Coded:
    """A table (by, syms, freq) whose syms are codes of the type ``kind`` that
    every pass takes through ``replay``. A few merges are cheaper made again in
    each pass than written and read; more are ``settled``."""

    frame: DataFrame
    kind: np.dtype
    replay: Replay

    @property
    def sparkSession(self) -> SparkSession:
        return self.frame.sparkSession

    @property
    def names(self) -> list[str]:
        return list(self.replay.number)

    def settled(self) -> Coded:
        """The same after the replay, staged, if that has many merges."""
        if self.replay.size <= UNROLLED:
            return self
        frame, old = self.frame, self.kind
        shared, kind = frame.sparkSession.sparkContext.broadcast(self.replay), self.replay.kind

        def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.schema.get_field_index("syms")
                for part in in_parts(batch, lengths_of(batch.column(place)), LETTERS):
                    raw, sizes = raw_of(part.column(place))
                    codes = column_of(*shared.value(raw.view(old), sizes // old.itemsize), kind)
                    yield pa.RecordBatch.from_arrays([codes if i == place else c for i, c in enumerate(part.columns)], schema=batch.schema)

        out = Coded(stage(frame.mapInArrow(replayed, frame.schema), "codes"), kind, Replay(self.names))
        unstage(frame)
        return out

    def merged(self, lists: list[list[tuple[str, str]]], splits: list[tuple[str, str, str]] = ()) -> Coded:
        """After lists of merges and then symbols split in two."""
        replay = Replay(self.names, self.replay)
        for merges in lists:
            replay.add(merges)
        for split in splits:
            replay.split(*split)
        return Coded(self.frame, self.kind, replay).settled()


def segment_text(segment: bytes, names: list[str]) -> str:
    """A segment of codes as in ``batching.segments_of``."""
    codes = np.frombuffer(segment, code_type(len(names)), offset=2)
    return segment[:2].decode() + "><".join([names[c] for c in codes])


def lengths_of(column: pa.Array) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64)


def raw_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a column, and how many each has."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    return raw, np.diff(bounds)


def column_of(ids: np.ndarray, sizes: np.ndarray, kind: np.dtype) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes * kind.itemsize)).astype(np.int32)
    codes = pa.py_buffer(np.ascontiguousarray(ids, kind))
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), codes])


def leftmost(place: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of pairs of equal symbols that overlap, every other one from the left."""
    n = np.arange(len(place))
    begins = np.append(True, following[place[:-1]] != place[1:])
    return place[(n - np.maximum.accumulate(np.where(begins, n, 0))) % 2 == 0]


def one_by_one(ids: np.ndarray, sizes: np.ndarray, merges: list[tuple[int, int, int]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The words after a few merges (left, right, made), each made once, in
    their order and from the left."""
    ids, begins = ids.astype(kind), np.zeros(len(ids), bool)
    begins[np.cumsum(sizes) - sizes] = True
    for left, right, made in merges:
        place = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
        place = place[~begins[place + 1]]
        if left == right and len(place):
            place = leftmost(place, np.arange(1, len(ids) + 1))
        if len(place):
            kept = np.ones(len(ids), bool)
            kept[place + 1] = False
            ids[place] = made
            ids, begins = ids[kept], begins[kept]
    return ids, np.diff(np.append(np.flatnonzero(begins), len(ids)))


def in_order(ids: np.ndarray, sizes: np.ndarray, merges: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for long lists: only places with a pair of the list are visited."""
    n, k = len(ids), len(merges)
    if not n or not k:
        return ids, sizes
    left, right, made = np.array(merges, np.int64).T
    table = Table(size, size, left, right, np.arange(k), k)
    ids, word = ids.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
    last = np.append(word[1:] != word[:-1], True)
    at = np.flatnonzero(~last)
    rank = table.get(ids[at], ids[at + 1])
    at, rank = at[rank < k], rank[rank < k]
    order = np.argsort(rank, kind="stable")
    at, bounds = at[order], np.searchsorted(rank[order], np.arange(k + 1))
    following, previous = np.where(last, -1, np.arange(1, n + 1)), np.arange(-1, n - 1)
    previous[np.append(True, last[:-1])] = -1
    alive, later = np.ones(n, bool), defaultdict(list)
    for r in range(k):
        place = at[bounds[r] : bounds[r + 1]]
        if r in later:
            place = np.unique(np.concatenate([place, *later.pop(r)]))
        place = place[alive[place] & (ids[place] == left[r])]
        after = following[place]
        place = place[(after >= 0) & (ids[after] == right[r])]
        if not len(place):
            continue
        if left[r] == right[r]:
            place = leftmost(place, following)
        gone = following[place]
        after = following[gone]
        ids[place], alive[gone], following[place] = made[r], False, after
        more = after >= 0
        previous[after[more]] = place[more]
        before = previous[place]
        touched = np.concatenate([place[more], before[before >= 0]])
        found = table.get(ids[touched], ids[following[touched]])
        new = (found < k) & (found > r)
        touched, found = touched[new], found[new]
        if len(found):
            sort = np.argsort(found, kind="stable")
            cuts = np.flatnonzero(np.diff(found[sort])) + 1
            for some in np.split(sort, cuts):
                later[int(found[some[0]])].append(touched[some])
    return ids[alive], np.bincount(word[alive], minlength=len(sizes))


def split_again(ids: np.ndarray, sizes: np.ndarray, old: int, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol ``old`` as two others."""
    met = ids == old
    if not met.any():
        return ids, sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    out = np.repeat(ids, 1 + met)
    at = np.flatnonzero(met) + np.arange(met.sum())
    out[at], out[at + 1] = left, right
    return out, sizes + np.bincount(word[met], minlength=len(sizes))


class Replay:
    """What turns codes by ``names`` into codes by the names with the merges'."""

    def __init__(self, names: list[str], before: Replay | None = None):
        self.number = {s: i for i, s in enumerate(names)}
        self.steps: list[tuple[str, object]] = [*before.steps] if before else []
        self.size = before.size if before else 0

    @property
    def kind(self) -> np.dtype:
        return code_type(len(self.number))

    def add(self, merges: list[tuple[str, str]]) -> None:
        """As ``wordtable.segment_all`` has it: up to UNROLLED merges one by one,
        longer lists by rank. That is the same unless a merge makes a symbol that
        an earlier one takes."""
        if not merges:
            return
        used, plain = set(), len(set(merges)) == len(merges)
        for left, right in merges:
            used |= {left, right}
            plain = plain and left + right not in used
            self.number.setdefault(left + right, len(self.number))
        self.size += len(merges)
        coded = [(self.number[a], self.number[b], self.number[a + b]) for a, b in merges if a in self.number and b in self.number]
        if plain:
            self.steps.append(("order", coded))
        elif len(merges) <= UNROLLED:
            self.steps += [("order", [one]) for one in coded]
        else:
            self.steps.append(("rank", {m: i for i, m in enumerate(merges)}))

    def split(self, old: str, left: str, right: str) -> None:
        self.size += 1
        self.steps.append(("split", (self.number[old], self.number[left], self.number[right])))

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for kind, what in self.steps:
            if kind == "order" and len(what) <= UNROLLED:
                ids, sizes = one_by_one(ids, sizes, what, self.kind)
            elif kind == "order":
                ids, sizes = in_order(ids, sizes, what, len(self.number))
            elif kind == "split":
                ids, sizes = split_again(ids.astype(self.kind), sizes, *what)
            else:
                merges = Merges(what)
                there = np.array([merges.number.get(s, merges.size + i) for s, i in self.number.items()])
                back = np.zeros(merges.size + len(there), np.int64)
                back[there] = np.arange(len(there))
                ids, sizes = merges.apply(there[ids], sizes)
                ids = back[ids]
        return ids, sizes


def coded(words: DataFrame, merges: list[tuple[str, str]] = ()) -> Coded:
    """(by, word, freq) as codes, after merges."""
    others = [c for c in words.columns if c not in ("word", "freq")]
    rows = stage(words.select(*others, F.encode("word", "UTF-8").alias("syms"), "freq"), "words")
    spread = stage_parts(rows)
    return Coded(spread, np.dtype("u1"), Replay(BYTES)).merged([list(merges)])


__all__ = ["BYTES", "Coded", "Replay", "coded", "code_type", "in_order", "one_by_one", "raw_of", "segment_text"]
