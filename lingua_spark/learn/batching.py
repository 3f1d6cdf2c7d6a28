"""Many merges per pass over the words, with the result of one at a time.

An epoch looks at the most frequent pairs of the corpus, its candidates, and at
the first pair that is none, its bound. A merge changes a word only around the
merged pair. So what the next merges do to the counts can be followed on small
pieces of the words, the segments: runs of symbols that are part of a candidate
pair somewhere in the word, with one untouched symbol on either side. Equal
segments of all words add up, in every task and then by one shuffle; they are
far fewer than the words, and their number is kept below ``Width.segments`` by
taking fewer candidates.

On the segments, an inverted index (pair -> segments) and signed differences of
counts replace counting anew: a merge visits the segments that hold its pair,
takes their old pairs off the counts and adds their new ones.

The counts of candidates and of pairs with a symbol made in this epoch are
complete, as all their occurrences lie in segments. Other pairs only become
rarer. So the best pair of the segments is the best of the corpus while

- it comes before the bound,
- no occurrence of it touches an untouched symbol, whose other side is unknown,
- no merge has made a symbol that existed before, whose other occurrences are
  not in the segments.

Otherwise the epoch ends and a new one counts afresh. The first merge of an
epoch always meets the conditions.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lingua_spark.learn.coded import Coded, segment_text
from lingua_spark.learn.wordtable import pair_counts, summed_in_tasks
from lingua_spark.runtime import stage, unstage

Pair = tuple[str, str]


@dataclass(frozen=True)
class Candidate:
    left: str
    right: str
    n: int

    @property
    def merged(self) -> str:
        return self.left + self.right

    @property
    def order(self) -> tuple[int, str, str]:
        return -self.n, self.left, self.right


@dataclass
class Width:
    """How many candidates an epoch takes, adapted to what they lead to.

    ``segments`` and ``letters`` bound what is sent to the driver.
    """

    pairs: int = 16
    segments: int = 150_000
    letters: int = 12_000_000
    most: int = 4096

    def fits(self, segments: int, letters: int) -> bool:
        """Whether so many may be fetched; narrows or widens the next epoch."""
        if self.pairs > 1 and (segments > self.segments or letters > self.letters):
            self.pairs = max(1, self.pairs // 2)
            return False
        if segments * 4 < self.segments and letters * 4 < self.letters:
            self.pairs = min(self.most, self.pairs * 2)
        return True


def leading_pairs(
    symbols: DataFrame | Coded, k: int, min_frequency: int, condition=None, by: tuple[str, ...] = ()
) -> dict[tuple, list[Candidate]]:
    """The k most frequent pairs of each group: count, then left, then right."""
    pairs = pair_counts(symbols, by).filter(F.col("n") >= min_frequency)
    if condition is not None:
        pairs = pairs.filter(condition)
    order = [F.desc("n"), F.col("left"), F.col("right")]
    if by:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        rows = pairs.withColumn("rank", rank).filter(F.col("rank") <= k).orderBy("rank").collect()
    else:
        rows = pairs.orderBy(*order).limit(k).collect()
    out: dict[tuple, list[Candidate]] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in by), []).append(Candidate(r["left"], r["right"], r["n"]))
    return out


def clear_leads(ranked: list[Candidate], whole: bool) -> list[Candidate]:
    """The first pairs of a count that are the most frequent one after another,
    whatever the merges before them make. ``whole``: there are no more pairs.

    A merge of (a, b) changes the counts of pairs that end with a or begin with b,
    and no pair of its new symbol is more frequent than one of these. So the
    next pair of the list is the best as long as it is none of them and, where
    several are equally frequent, none of the others is.
    """
    taken: list[Candidate] = []
    lefts, rights = set(), set()
    for c in ranked:
        level = [p for p in ranked if p.n == c.n]
        if taken and (any(p.right in lefts or p.left in rights for p in level) or (not whole and level[-1] is ranked[-1])):
            break
        taken.append(c)
        lefts.add(c.left)
        rights.add(c.right)
        if c.left == c.right:
            break  # its own overlaps become pairs of the new symbol
    return taken


def segments_of(parts: list[str], keys: set[Pair]) -> Iterator[str]:
    """Segments of a word: two flags for untouched symbols at the ends, then
    the symbols."""
    n = len(parts)
    active = [False] * n
    for i in range(n - 1):
        if (parts[i], parts[i + 1]) in keys:
            active[i] = active[i + 1] = True
    i = 0
    while i < n:
        if not active[i]:
            i += 1
            continue
        end = i
        while end < n and active[end]:
            end += 1
        left, right = i > 0, end < n
        yield f"{left:d}{right:d}" + "><".join(parts[i - left : end + right])
        i = end


def segment_table(symbols: DataFrame | Coded, keys: set[Pair], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, segment, freq) of all words, added up in the tasks first."""
    sent = symbols.sparkSession.sparkContext.broadcast(keys)
    return summed_in_tasks(symbols, by, lambda words: words.segments(sent.value), ["segment"], "freq")


class Epoch:
    """Segments of one or several groups (languages), merged one by one."""

    def __init__(self, candidates: Iterable[Pair], allowed: Callable[[str, str], bool] = lambda left, right: True):
        self.candidates, self.allowed = set(candidates), allowed
        self.fresh: set[str] = set()
        self.bounds: dict[object, tuple | None] = {}
        self.parts: list[list[str]] = []
        self.ends: list[tuple[bool, bool]] = []
        self.freq: list[int] = []
        self.group: list[object] = []
        self.where: dict[Pair, set[int]] = defaultdict(set)
        self.counts: dict[object, dict[Pair, int]] = defaultdict(dict)
        self.heaps: dict[object, list[tuple[int, str, str]]] = defaultdict(list)
        self.edge: set[Pair] = set()

    def add(self, group: object, segment: str, freq: int) -> None:
        self.parts.append(segment[2:].split("><"))
        self.ends.append((segment[0] == "1", segment[1] == "1"))
        self.freq.append(freq)
        self.group.append(group)
        self._count(len(self.parts) - 1, 1)

    def ready(self, bounds: dict[object, Candidate | None]) -> Epoch:
        """All segments are there; ``bounds`` by group."""
        self.bounds = {g: None if c is None else c.order for g, c in bounds.items()}
        for group, counts in self.counts.items():
            self.heaps[group] = [(-n, *pair) for pair, n in counts.items() if self.allowed(*pair)]
            heapq.heapify(self.heaps[group])
        return self

    def _count(self, i: int, sign: int) -> list[Pair]:
        """Add or take off the pairs of a segment whose counts are complete."""
        parts, counts, n = self.parts[i], self.counts[self.group[i]], sign * self.freq[i]
        (left, right), last, met = self.ends[i], len(self.parts[i]) - 2, []
        for at in range(last + 1):
            pair = parts[at], parts[at + 1]
            if pair not in self.candidates and pair[0] not in self.fresh and pair[1] not in self.fresh:
                continue
            counts[pair] = counts.get(pair, 0) + n
            met.append(pair)
            if sign > 0:
                self.where[pair].add(i)
                if (at == 0 and left) or (at == last and right):
                    self.edge.add(pair)
        return met

    def next(self, group: object = (), min_frequency: int = 1) -> Candidate | None:
        """The group's best pair, None if only a new epoch can tell."""
        heap, counts = self.heaps[group], self.counts[group]
        while heap and counts.get(heap[0][1:], 0) != -heap[0][0]:
            heapq.heappop(heap)
        if not heap or -heap[0][0] < min_frequency:
            return None
        bound = self.bounds.get(group)
        if (bound is not None and heap[0] >= bound) or heap[0][1:] in self.edge:
            return None
        return Candidate(heap[0][1], heap[0][2], -heap[0][0])

    def merge(self, left: str, right: str) -> dict[object, int]:
        """Merge a pair everywhere; how many were merged in each group."""
        merged, made = left + right, defaultdict(int)
        touched: dict[object, set[Pair]] = defaultdict(set)
        for i in self.where.pop((left, right), ()):
            old, new, at = self.parts[i], [], 0
            while at < len(old):
                if old[at] == left and at + 1 < len(old) and old[at + 1] == right:
                    new.append(merged)
                    at += 2
                else:
                    new.append(old[at])
                    at += 1
            if len(new) == len(old):
                continue
            met = touched[self.group[i]]
            met.update(self._count(i, -1))
            self.parts[i] = new
            made[self.group[i]] += (len(old) - len(new)) * self.freq[i]
            self.fresh.add(merged)
            met.update(self._count(i, 1))
            self.fresh.discard(merged)
        self.fresh.add(merged)
        for group, pairs in touched.items():
            for pair in pairs:
                if self.counts[group][pair] > 0 and self.allowed(*pair):
                    heapq.heappush(self.heaps[group], (-self.counts[group][pair], *pair))
        return made


def epoch(
    symbols: DataFrame | Coded,
    width: Width,
    min_frequency: int = 2,
    condition=None,
    allowed: Callable[[str, str], bool] = lambda left, right: True,
    by: tuple[str, ...] = (),
    others: DataFrame | Coded | None = None,
) -> tuple[Epoch, dict[tuple, list[Candidate]]] | None:
    """Count, choose candidates and fetch their segments; None if no pair is
    frequent enough.

    ``others`` (development texts) have segments and counts, but no say in the
    candidates; their groups are named ``("dev", *group)``. They may be the same
    table, whose segments are then fetched once.
    """
    pairs = width.pairs
    ranked = leading_pairs(symbols, pairs + 1, min_frequency, condition, by)
    if not ranked:
        return None
    sources = [symbols] if others is None or others is symbols else [symbols, others]
    while True:
        taken = {g: c[:pairs] for g, c in ranked.items()}
        keys = {(c.left, c.right) for found in taken.values() for c in found}
        tables = [stage(segment_table(t, keys, by), "segments") for t in sources]
        sizes = [t.agg(F.count("*"), F.coalesce(F.sum(F.length("segment")), F.lit(0))).first() for t in tables]
        if width.fits(sum(s[0] for s in sizes), sum(s[1] for s in sizes)):
            break
        for table in tables:
            unstage(table)
        pairs = min(pairs, width.pairs)
    out = Epoch(keys, allowed)
    names = [((), ("dev",))] if others is symbols else [((),), (("dev",),)]
    for prefixes, source, table in zip(names, sources, tables):
        coded_by = source.names if isinstance(source, Coded) else None
        for row in table.toLocalIterator():
            segment = row["segment"] if coded_by is None else segment_text(row["segment"], coded_by)
            for name in prefixes:
                out.add((*name, *(row[c] for c in by)), segment, row["freq"])
        unstage(table)
    bounds = {g: c[pairs] if len(c) > pairs else None for g, c in ranked.items()}
    return out.ready(bounds), ranked


__all__ = ["Candidate", "Epoch", "Width", "clear_leads", "epoch", "leading_pairs", "segment_table", "segments_of"]
