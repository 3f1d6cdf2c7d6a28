"""Symbols of many words side by side, as numpy arrays inside tasks.

The words of a batch become one array of symbol numbers, so that counting pairs
and cutting segments cost a few array operations instead of a loop per word. A
batch is taken in parts of about LETTERS letters, whatever its rows hold, and
what the parts give is added up before it leaves the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTERS = 1 << 22
ROWS = 200_000  # sums kept before they are passed on
TABLE = 1 << 20  # pairs counted in a plain table


def in_parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows in a row whose sizes make about ``most``; a larger row is alone."""
    if not len(sizes):
        return
    part = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
    for at, to in zip(starts, np.append(starts[1:], len(sizes))):
        yield batch.slice(at, to - at)


class Flat:
    """The symbols of the words of a batch with the columns syms and freq."""

    cut = pa.string()  # the type of its segments

    def __init__(self, batch: pa.RecordBatch, by: tuple[str, ...] = ()):
        words = batch.column(batch.schema.get_field_index("syms"))
        parts = pc.split_pattern(pc.utf8_slice_codeunits(words, 1, -1), "><")
        coded = parts.flatten().dictionary_encode()
        self.words, self.names = words, coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.cut_words(batch, pc.list_value_length(parts).to_numpy(), by)

    def cut_words(self, batch: pa.RecordBatch, lengths: np.ndarray, by: tuple[str, ...]) -> None:
        """Which symbols make which word, and the words' frequencies and groups."""
        self.word_of = np.repeat(np.arange(len(lengths)), lengths)
        ends = np.cumsum(lengths)
        self.begins, self.finishes = np.zeros((2, len(self.ids)), bool)
        self.begins[ends - lengths] = self.finishes[ends - 1] = True
        self.freq = batch.column(batch.schema.get_field_index("freq")).to_numpy()
        self.by, self.groups = by, [
            batch.column(batch.schema.get_field_index(c)).dictionary_encode(null_encoding="encode") for c in by
        ]

    def group_codes(self) -> np.ndarray:
        code = np.zeros(len(self.freq), np.int64)
        for group in self.groups:
            code = code * len(group.dictionary) + group.indices.to_numpy()
        return code

    def group_columns(self, code: np.ndarray) -> dict[str, pa.Array]:
        out = {}
        for name, group in reversed([*zip(self.by, self.groups)]):
            out[name] = group.dictionary.take(pa.array(code % len(group.dictionary)))
            code = code // len(group.dictionary)
        return out

    def summed(self, codes: np.ndarray, at: np.ndarray | slice, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, code and sum of the frequencies of the words it is found in,
        which are those of the symbols ``at``; codes are below ``size``."""
        codes = self.group_codes()[self.word_of[at]] * size + codes if self.by else codes
        whole = size * math.prod(max(len(g.dictionary), 1) for g in self.groups)
        alike = len(self.freq) > 0 and (self.freq == self.freq[0]).all()  # as whole texts are
        if codes.size and whole <= TABLE:
            seen = np.bincount(codes, minlength=whole)
            found = np.flatnonzero(seen)
            sums = seen[found] * self.freq[0] if alike else np.bincount(codes, self.freq[self.word_of[at]], whole)[found]
        else:
            found, place = np.unique(codes, return_inverse=True)
            sums = np.bincount(place, self.freq[self.word_of[at]], len(found))
        return found // size, found % size, sums.astype(np.int64)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of all symbols with a follower, and the codes of the pairs."""
        inside = ~self.finishes[:-1]
        return np.flatnonzero(inside), (self.ids[:-1] * len(self.names) + self.ids[1:])[inside]

    def pair_sums(self) -> pa.Table:
        at, codes = self.pairs()
        k = len(self.names)
        group, code, n = self.summed(codes, at, k * k)
        names = {"left": self.names.take(pa.array(code // max(k, 1))), "right": self.names.take(pa.array(code % max(k, 1)))}
        return pa.table({**self.group_columns(group), **names, "n": pa.array(n)})

    def symbol_sums(self) -> pa.Table:
        group, code, n = self.summed(self.ids, slice(None), max(len(self.names), 1))
        return pa.table({**self.group_columns(group), "token": self.names.take(pa.array(code)), "n": pa.array(n)})

    def segments(self, keys: Iterable[tuple[str, str]]) -> pa.Table:
        """The segments as in ``batching.segments_of``, with their words' frequencies."""
        number = {name: i for i, name in enumerate(self.names.to_pylist())}
        wanted = [number[a] * len(number) + number[b] for a, b in keys if a in number and b in number]
        at, codes = self.pairs()
        if len(number) ** 2 <= TABLE:
            chosen = np.zeros(len(number) ** 2 + 1, bool)
            chosen[wanted] = True
            hit = at[chosen[codes]]
        else:
            hit = at[np.isin(codes, np.array(wanted, np.int64))]
        active = np.zeros(len(self.ids), bool)
        active[hit] = active[hit + 1] = True
        before, behind = np.append(False, active[:-1]), np.append(active[1:], False)
        starts = np.flatnonzero(active & (self.begins | ~before))
        stops = np.flatnonzero(active & (self.finishes | ~behind))
        left, right = ~self.begins[starts], ~self.finishes[stops]
        begin, end = self.bounds(starts - left, stops + right)
        letters = end - begin + 2
        offsets = np.append(0, np.cumsum(letters))
        places = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], letters)
        text = self.letters()[places]  # two letters early, where the flags go
        text[offsets[:-1]], text[offsets[:-1] + 1] = 48 + left, 48 + right
        cut = pa.Array.from_buffers(self.cut, len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
        words = self.word_of[starts]
        groups = self.group_columns(self.group_codes()[words]) if self.by else {}
        return pa.table({**groups, "segment": cut, "freq": pa.array(self.freq[words])})

    def bounds(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where slices of symbols begin and end in the words: <74><68> holds each
        symbol between signs."""
        sizes = pc.binary_length(self.names).to_numpy().astype(np.int64)[self.ids] if len(self.ids) else self.ids
        ahead = np.cumsum(sizes + 2) - sizes - 1
        return ahead[first], ahead[last] + sizes[last]

    def letters(self) -> np.ndarray:
        """The letters of all words, two others before them."""
        _, offsets, data = self.words.buffers()
        bounds = np.frombuffer(offsets, np.int32)[self.words.offset : self.words.offset + len(self.words) + 1]
        raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
        return np.concatenate([np.zeros(2, np.uint8), raw])


def together(tables: Iterable[pa.Table], keys: list[str], value: str) -> Iterator[pa.RecordBatch]:
    """The tables' sums by ``keys``, passed on whenever they are many."""
    kept: list[pa.Table] = []

    def sums() -> pa.Table:
        table = pa.concat_tables(kept).group_by(keys).aggregate([(value, "sum")])
        return table.select([*keys, f"{value}_sum"]).rename_columns([*keys, value])

    for one in tables:
        kept.append(one)
        if len(kept) > 1 and sum(t.num_rows for t in kept) >= ROWS:
            kept = [sums()]
            if kept[0].num_rows >= ROWS:
                yield from kept.pop().to_batches()
    if kept:
        yield from sums().to_batches()


class FlatCodes(Flat):
    """The same of syms that are codes of the type ``kind``, after a replay;
    segments are slices of codes."""

    cut = pa.binary()

    def __init__(self, batch: pa.RecordBatch, by: tuple[str, ...], names: pa.Array, kind: np.dtype, replay):
        words = batch.column(batch.schema.get_field_index("syms")).cast(pa.large_binary())
        _, offsets, data = words.buffers()
        places = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data else np.empty(0, np.uint8)
        codes, lengths = replay(raw.view(kind), np.diff(places) // kind.itemsize)
        self.codes = np.ascontiguousarray(codes, replay.kind)
        self.names, self.ids = names, self.codes.astype(np.int64)
        if len(names) ** 2 > TABLE:
            present = np.bincount(self.codes, minlength=len(names)) > 0
            self.ids, self.names = (np.cumsum(present) - 1)[self.codes], names.filter(pa.array(present))
        self.cut_words(batch, lengths, by)

    def bounds(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return first * self.codes.itemsize, (last + 1) * self.codes.itemsize

    def letters(self) -> np.ndarray:
        return np.concatenate([np.zeros(2, np.uint8), self.codes.view(np.uint8)])


def added_up(
    batches: Iterable[pa.RecordBatch], by: tuple[str, ...], of_part, keys: list[str], value: str, flat=Flat
) -> Iterator[pa.RecordBatch]:
    """What ``of_part`` gives for parts of the batches, summed over each task."""

    def tables() -> Iterator[pa.Table]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(batch.schema.get_field_index("syms"))).to_numpy().astype(np.int64)
            for part in in_parts(batch, lengths, LETTERS):
                yield of_part(flat(part, by))

    return together(tables(), keys, value)


__all__ = ["Flat", "FlatCodes", "added_up", "in_parts", "together"]
