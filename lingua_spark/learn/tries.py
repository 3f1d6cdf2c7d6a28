"""Words and pieces as tries on arrays, for passes over all words of a corpus.

Sorted words share the nodes of what they begin with; a level of nodes is taken
at once. An automaton of the pieces (Aho-Corasick) knows for each node the
longest piece that ends there, and for each piece the next shorter one that it
ends in, so that only pieces that occur are looked at. Paths are summed once per
node instead of once per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lingua_spark.learn.segmenting import slices

LETTERS = 1 << 20  # letters of the words of one trie, about
NOTHING = float("-inf")


class Letters(NamedTuple):
    """The letters of an array of words: UTF-8, where each letter begins there
    and at last the end, and the number of each word's first letter and the end."""

    raw: np.ndarray
    begins: np.ndarray
    first: np.ndarray

    def codes(self) -> np.ndarray:
        text = self.raw.tobytes().decode("utf-8", "surrogatepass")
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def parts(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The texts between letters."""
        begin, end = self.begins[start], self.begins[stop]
        offsets = np.append(0, np.cumsum(end - begin))
        data = self.raw[slices(begin, end - begin)]
        return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def letters_of(words: pa.Array) -> Letters:
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    begins = np.flatnonzero((raw & 0xC0) != 0x80)
    return Letters(raw, np.append(begins, len(raw)), np.searchsorted(begins, bounds - bounds[0]))


def gathered(batches: Iterator[pa.RecordBatch], name: str, size: int = LETTERS) -> Iterator[pa.Table]:
    """Batches put together until their column ``name`` has about ``size`` bytes."""
    waiting, held = [], 0
    for batch in batches:
        waiting.append(batch)
        held += pc.sum(pc.binary_length(batch.column(name))).as_py() or 0
        if held >= size:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, held = [], 0
    if any(len(b) for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks()


class Trie(NamedTuple):
    """Nodes by level, the root before them; ``bounds`` has the first node of
    each level and the number of nodes, ``row`` a word that a node begins,
    ``ends`` the node of each word."""

    parent: np.ndarray
    letter: np.ndarray
    row: np.ndarray
    bounds: np.ndarray
    ends: np.ndarray

    @property
    def levels(self) -> list[tuple[int, int]]:
        return list(zip(self.bounds.tolist(), self.bounds[1:].tolist()))


def trie(codes: np.ndarray, first: np.ndarray) -> Trie:
    """The trie of words sorted by their letters."""
    sizes, starts = np.diff(first), first[:-1]
    ends = np.zeros(len(sizes), np.int32)
    same = np.ones(len(sizes), bool)  # as the word before, up to this level
    rows, level, bounds = np.arange(len(sizes)), 0, [1]
    nodes = [(np.zeros(1, np.int32), np.zeros(1, np.uint32), np.zeros(1, np.int32))]
    while True:
        longer = sizes[rows] > level
        rows = rows if longer.all() else rows[longer]
        if not len(rows):
            break
        letter = codes[starts[rows] + level]
        old = np.append(False, (rows[1:] == rows[:-1] + 1) & (letter[1:] == letter[:-1])) & same[rows]
        same[rows] = old
        new = np.flatnonzero(~old)
        nodes.append((ends[rows[new]], letter[new], rows[new].astype(np.int32)))
        ends[rows] = np.cumsum(~old) + (bounds[-1] - 1)
        bounds.append(bounds[-1] + len(new))
        level += 1
    parent, letter, row = (np.concatenate(column) for column in zip(*nodes))
    return Trie(parent, letter, row, np.array(bounds, np.int64), ends)


def part_counts(words: pa.Array, freq: np.ndarray, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What sorted words begin with, with counts and whether these are whole:
    other sorted words may begin as the first or last of these do. Whole counts
    below ``least`` are left out, but for single letters."""
    letters = letters_of(words)
    nodes = trie(letters.codes(), letters.first)
    counts = np.zeros(len(nodes.parent), np.int64)
    np.add.at(counts, nodes.ends, freq)
    for start, stop in reversed(nodes.levels):
        parents = nodes.parent[start:stop]
        runs = np.flatnonzero(np.diff(parents, prepend=-1))
        counts[parents[runs]] += np.add.reduceat(counts[start:stop], runs)
    whole = nodes.row > 0
    node = nodes.ends[-1]
    while node:
        whole[node], node = False, nodes.parent[node]
    depth = np.repeat(np.arange(len(nodes.bounds)), np.diff(nodes.bounds, prepend=0))
    kept = np.flatnonzero((depth > 0) & (~whole | (counts >= least) | (depth == 1)))
    start = letters.first[nodes.row[kept]]
    return letters.parts(start, start + depth[kept]), counts[kept], whole[kept]


def tails(words: pa.Array, freq: np.ndarray, longest: int) -> pa.Table:
    """From each letter of the words, the letters up to ``longest``; equal ones
    are added up."""
    letters = letters_of(words)
    sizes = np.diff(letters.first)
    start = np.arange(letters.first[-1])
    stop = np.minimum(start + longest, np.repeat(letters.first[1:], sizes))
    table = pa.table({"tail": letters.parts(start, stop), "freq": np.repeat(freq, sizes)})
    sums = table.group_by("tail").aggregate([("freq", "sum")])
    return pa.table({"tail": sums["tail"], "freq": sums["freq_sum"]})


class Automaton:
    """Of pieces sorted by their letters; its states are the nodes of their trie."""

    def __init__(self, pieces: pa.Array):
        letters = letters_of(pieces)
        codes = letters.codes()
        self.nodes = trie(codes, letters.first)
        self.longest = len(self.nodes.bounds) - 1
        self.letters = np.unique(codes)
        self.width = max(len(self.letters), 1)
        letter = self.numbered(self.nodes.letter)
        # in order, as nodes are by level and then by what they spell
        self.codes = self.nodes.parent[1:].astype(np.int64) * self.width + letter[1:]
        self.fail = np.zeros(len(letter), np.int32)
        for start, stop in self.nodes.levels[1:]:
            self.fail[start:stop] = self.step(self.fail[self.nodes.parent[start:stop]], letter[start:stop])

    def numbered(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of letters, -1 for those of no piece."""
        if not len(self.letters):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, -1)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The longest state that the letters up to these end in."""
        out = np.zeros(len(state), np.int32)
        at = np.flatnonzero(letter >= 0)
        state, letter = state[at], letter[at]
        while len(at):
            codes = state.astype(np.int64) * self.width + letter
            found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[found] == codes
            out[at[hit]] = found[hit] + 1
            more = ~hit & (state > 0)
            at, state, letter = at[more], self.fail[state[more]], letter[more]
        return out

    def states(self, nodes: Trie) -> np.ndarray:
        state, letter = np.zeros(len(nodes.parent), np.int32), self.numbered(nodes.letter)
        for start, stop in nodes.levels:
            state[start:stop] = self.step(state[nodes.parent[start:stop]], letter[start:stop])
        return state

    def endings(self, logp: np.ndarray) -> Endings:
        """By the log-probabilities of all pieces; pieces without one are none."""
        alive = np.flatnonzero(logp > NOTHING)
        none = len(alive)
        own = np.full(len(self.fail), none, np.int32)  # the piece that a state is
        own[self.nodes.ends[alive]] = np.arange(none, dtype=np.int32)
        first = np.full(len(self.fail), none, np.int32)
        kind = np.int8 if self.longest < 127 else np.int32
        following, chain, size = np.full(none + 1, none, np.int32), np.ones(none + 1, kind), np.ones(none + 1, kind)
        for level, (start, stop) in enumerate(self.nodes.levels):
            shorter, here = first[self.fail[start:stop]], own[start:stop]
            first[start:stop] = np.where(here < none, here, shorter)
            at = np.flatnonzero(here < none)
            here, shorter = here[at], shorter[at]
            following[here], size[here] = shorter, level + 1
            chain[here] = np.where(shorter < none, chain[shorter], 0) + 1
        return Endings(first, following, chain, size, np.append(logp[alive], NOTHING), self.longest)


class Endings(NamedTuple):
    """For each state the longest piece it ends in, ``none`` if there is none;
    for each piece the next shorter one it ends in, how many there are with
    itself, its letters and its log-probability."""

    first: np.ndarray
    following: np.ndarray
    chain: np.ndarray
    size: np.ndarray
    logp: np.ndarray
    longest: int

    @property
    def none(self) -> int:
        return len(self.logp) - 1

    def of(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that states end in, longest first, and where each state's
        begin; a state without any has ``none``."""
        now = self.first[state]
        count = self.chain[now]
        stops = np.cumsum(count, dtype=np.int64)
        starts = stops - count
        pieces = np.empty(stops[-1] if len(stops) else 0, np.int32)
        place, left = starts, count
        while len(now):
            pieces[place] = now
            more = left > 1
            now, place, left = self.following[now[more]], place[more] + 1, left[more] - 1
        return pieces, starts


class Level(NamedTuple):
    """Nodes ``start`` to ``stop`` and the pieces they end in: numbers, the nodes
    before them, where each node's pieces begin, and ``low``, a node not after
    any of the nodes before."""

    start: int
    stop: int
    pieces: np.ndarray
    before: np.ndarray
    places: np.ndarray
    low: int

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the level's nodes for all their pieces."""
        return np.repeat(values, np.diff(self.places, append=len(self.pieces)))


class Paths:
    """All ways to spell the words of a trie; ``state`` is that of each node."""

    def __init__(self, nodes: Trie, state: np.ndarray, endings: Endings):
        self.nodes, self.state, self.endings = nodes, state, endings

    def levels(self) -> Iterator[Level]:
        found, parent, bounds = self.endings, self.nodes.parent, self.nodes.bounds
        width = max(1, min(found.longest, len(bounds) - 1))
        above = np.zeros((1, width), np.int32)  # the nodes 1, 2, .. letters before a level's
        last = 0
        for level, (start, stop) in enumerate(self.nodes.levels):
            table = np.empty((stop - start, width), np.int32)
            table[:, 0] = parent[start:stop]
            table[:, 1:] = above[parent[start:stop] - last, :-1]
            above, last = table, start
            pieces, places = found.of(self.state[start:stop])
            counts = np.diff(places, append=len(pieces))
            rows = np.repeat(np.arange(0, len(table) * width, width), counts)
            before = table.ravel()[rows + (found.size[pieces] - 1)]
            yield Level(start, stop, pieces, before, places, int(bounds[level - width]) if level >= width else 0)

    def _counted(self, score: np.ndarray, freq: np.ndarray, shares) -> tuple[float, np.ndarray]:
        """The words' counts sent back along their paths. ``shares`` are, from the
        last level to the first, the pieces on them with the shares of their
        nodes' counts."""
        ends, counts = self.nodes.ends, np.zeros(len(self.endings.logp))
        spelled = score[ends] > NOTHING
        flow = np.bincount(ends, np.where(spelled, freq, 0.0), len(score)).astype(float)
        used = []
        for level, pieces, before, share in shares(flow):
            flow[level.low : level.start] += np.bincount(before - level.low, share, level.start - level.low)
            used.append((pieces, share))
        if used:
            pieces, share = (np.concatenate(column) for column in zip(*used))
            counts = np.bincount(pieces, share, len(counts))
        return float(score[ends[spelled]] @ freq[spelled]), counts[:-1]

    def expectation(self, freq: np.ndarray) -> tuple[float, np.ndarray]:
        """The log-likelihood and the expected count of each piece. Words that no
        pieces spell add nothing."""
        score, kept = np.full(len(self.state), NOTHING), []
        score[0] = 0.0
        for level in self.levels():
            share = score[level.before] + self.endings.logp[level.pieces]
            top = np.maximum.reduceat(share, level.places)
            top[top == NOTHING] = 0.0
            share -= level.spread(top)
            np.exp(share, out=share)
            total = np.add.reduceat(share, level.places)
            with np.errstate(divide="ignore"):
                score[level.start : level.stop] = top + np.log(total)
            total[total == 0.0] = 1.0
            share /= level.spread(total)
            kept.append((level, share))

        def shares(flow):
            while kept:
                level, share = kept.pop()
                share *= level.spread(flow[level.start : level.stop])
                yield level, level.pieces, level.before, share

        return self._counted(score, freq, shares)

    def best(self, freq: np.ndarray) -> tuple[float, np.ndarray]:
        """The log-probability of the words' most likely paths, and how often each
        piece is on them; of equal ones the longest piece at the end counts."""
        score, kept = np.full(len(self.state), NOTHING), []
        score[0] = 0.0
        for level in self.levels():
            value = score[level.before] + self.endings.logp[level.pieces]
            top = np.maximum.reduceat(value, level.places)
            score[level.start : level.stop] = top
            at = np.flatnonzero(value == level.spread(top))
            node = level.spread(np.arange(len(top)))[at]
            chosen = at[np.diff(node, prepend=-1) > 0]
            kept.append((level._replace(pieces=None, before=None), level.pieces[chosen], level.before[chosen]))

        def shares(flow):
            while kept:
                level, pieces, before = kept.pop()
                yield level, pieces, before, flow[level.start : level.stop]

        return self._counted(score, freq, shares)

    def gaps(self) -> np.ndarray:
        """By node, what the most likely path loses without a piece that is all
        of it; 0 where there is no such piece."""
        score, lost = np.full(len(self.state), NOTHING), np.zeros(len(self.state))
        score[0] = 0.0
        for depth, level in enumerate(self.levels(), 1):
            value = score[level.before] + self.endings.logp[level.pieces]
            score[level.start : level.stop] = np.maximum.reduceat(value, level.places)
            first = level.pieces[level.places]
            all_of_it = (self.endings.size[first] == depth) & (first < self.endings.none)
            whole = value[level.places]
            value[level.places[all_of_it]] = NOTHING
            rest = np.maximum(np.maximum.reduceat(value, level.places), -1e6 * depth)
            lost[level.start : level.stop] = np.where(all_of_it, whole - rest, 0.0)
        return lost
