"""Benchmark decontamination by pigeonhole edit matching.

A test item of ``m`` letters may differ from a document's passage by ``k``
letters inserted, deleted or replaced. Cut the item into ``k + 1`` pieces: k
edits cannot touch all of them, so every such passage holds at least one piece
unchanged, at most k places from where the item would put it. Pieces are found
by one automaton over all of them; around each hit Myers' bit-parallel
algorithm measures the least edit distance of the item to any passage.

The test items are the fixed query set: they are taken in blocks of bounded
size, and each block makes one map-only pass over the documents. Nothing is
shuffled but the matches.

Defined cases: text is compared in lower case with white space collapsed; a
null text or item counts as empty; items shorter than ``least_letters`` after
this never match, as they would match by chance; repeated items and documents
each give their own rows; empty tables give no rows. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import frugal


@dataclass(frozen=True)
class Matching:
    """``error_rate``: edits allowed per letter of the item, rounded down.
    ``block_letters``: letters of test items handled in one pass."""

    error_rate: float = 0.08
    least_letters: int = 40
    block_letters: int = 8_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, options: Matching) -> int:
    return int(len(item) * options.error_rate)


def cut(item: str, pieces: int) -> list[tuple[int, str]]:
    """The item in ``pieces`` parts of near equal length, with their places."""
    edges = [len(item) * i // pieces for i in range(pieces + 1)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Myers' algorithm for one item; its bit vectors are Python integers."""

    def __init__(self, item: str):
        self.length = len(item)
        self.last, self.all = 1 << (len(item) - 1), (1 << len(item)) - 1
        self.places: dict[str, int] = {}
        for i, letter in enumerate(item):
            self.places[letter] = self.places.get(letter, 0) | 1 << i

    def best(self, text: str, most: int) -> tuple[int, int] | None:
        """Least distance of the item to any passage of ``text`` and where that
        passage ends (the first such end); None above ``most``."""
        ups, downs, score = self.all, 0, self.length
        least, end, every, last, places = most + 1, 0, self.all, self.last, self.places.get
        for at, letter in enumerate(text, 1):
            same = places(letter, 0)
            diagonal = (((same & ups) + ups) ^ ups) | same | downs
            rises = downs | ~(diagonal | ups) & every
            falls = ups & diagonal
            if rises & last:
                score += 1
            elif falls & last:
                score -= 1
                if score < least:
                    least, end = score, at
            rises = rises << 1 & every  # a passage may begin anywhere
            ups = (falls << 1 & every) | ~(diagonal | rises) & every
            downs = rises & diagonal
        return (least, end) if least <= most else None


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[object, str]], options: Matching):
        self.items, self.patterns, self.options = items, {}, options
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            for place, piece in cut(item, budget(item, options) + 1):
                pieces.setdefault(piece, []).append((number, place))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Per item the stretches of text that could hold it."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (length, owners) in self.automaton.iter(text):
            for number, place in owners:
                item = self.items[number][1]
                slack = budget(item, self.options)
                begin = end + 1 - length - place
                low, high = max(0, begin - slack), min(len(text), begin + len(item) + slack)
                spans = found.setdefault(number, [])
                if spans and low <= spans[-1][1]:
                    # hits come in text order, pieces of one item need not
                    while spans and low <= spans[-1][1]:
                        a, b = spans.pop()
                        low, high = min(a, low), max(b, high)
                spans.append((low, high))
        return found

    def matches(self, text: str | None) -> list[tuple[object, int, int]]:
        """Item id, least distance and end (in the plain text) of each match."""
        text = plain(text)
        if not self.items or not text:
            return []
        out = []
        for number, spans in self.windows(text).items():
            key, item = self.items[number]
            slack = budget(item, self.options)
            best = None
            for low, high in spans:
                if high - low < len(item) - slack:
                    continue
                if number not in self.patterns:
                    self.patterns[number] = Pattern(item)
                hit = self.patterns[number].best(text[low:high], slack)
                if hit and (best is None or hit[0] < best[0]):
                    best = hit[0], low + hit[1]
            if best:
                out.append((key, *best))
        return out


def blocks(benchmark: DataFrame, options: Matching, item: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The test items in lists of at most ``block_letters`` letters, or one
    item; the driver holds one list and one partition at a time."""
    block, letters = [], 0
    for row in benchmark.select(F.col(item).alias("item"), F.col(text).alias("text")).toLocalIterator():
        plain_text = plain(row["text"])
        if len(plain_text) < options.least_letters:
            continue
        if block and letters + len(plain_text) > options.block_letters:
            yield block
            block, letters = [], 0
        block.append((row["item"], plain_text))
        letters += len(plain_text)
    if block:
        yield block


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    options: Matching = Matching(),
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and test item that it holds: both keys, the edit
    distance and the end of the passage in the plain text."""
    frugal(docs.sparkSession)
    kind = dict(benchmark.dtypes)[item]
    kinds = f"array<struct<item:{kind},distance:int,passage_end:int>>"
    results = None
    for block in blocks(benchmark, options, item, item_text):
        rows = docs.select(F.col(key).alias("key"), _leaks(block, options, kinds)(docs[text]).alias("leaks"))
        rows = rows.select("key", F.inline("leaks"))
        results = rows if results is None else results.unionByName(rows)
    if results is None:
        results = docs.select(
            F.col(key).alias("key"),
            *[F.lit(None).cast(t).alias(n) for n, t in (("item", kind), ("distance", "int"), ("passage_end", "int"))],
        ).limit(0)
    return results.select(F.col("key").alias(key), F.col("item").alias(item), "distance", "passage_end")


def _leaks(block: list, options: Matching, kinds: str):
    held = {}

    @F.pandas_udf(kinds)
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = held.get(0) or held.setdefault(0, Matcher(block, options))
        for texts in batches:
            found = [
                [{"item": k, "distance": d, "passage_end": e} for k, d, e in matcher.matches(t)] for t in texts
            ]
            yield pd.Series(found, dtype=object)

    return leaks


def drop_leaks(docs: DataFrame, benchmark: DataFrame, options: Matching = Matching()) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    frugal(docs.sparkSession)
    kind = dict(benchmark.dtypes)["item_id"]
    kinds = f"array<struct<item:{kind},distance:int,passage_end:int>>"
    for block in blocks(benchmark, options, "item_id", "text"):
        docs = docs.filter(F.size(_leaks(block, options, kinds)(docs["text"])) == 0)
    return docs
