"""Per-word segmentation, the small Python helpers inside tasks."""

from __future__ import annotations

import hashlib
import heapq
import itertools


def merge_symbols(symbols: list[str], ranks: dict, skip=None) -> list[str]:
    """Apply learned merges lowest rank first.

    A linked list and a heap of present pairs: near-linear, so that whole
    texts as single pre-tokens stay affordable. ``skip()`` may leave a merge
    out; it is tried again after the next one that is made.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    parts = list(symbols)
    following = list(range(1, n)) + [-1]
    previous = [-1] + list(range(n - 1))
    heap: list[tuple] = []
    skipped: list[tuple] = []

    def offer(i: int, j: int) -> None:
        rank = ranks.get((parts[i], parts[j]))
        if rank is not None:
            heapq.heappush(heap, (rank, i, parts[i], parts[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        entry = heapq.heappop(heap)
        _, i, left, right = entry
        j = following[i] if parts[i] == left else -1
        if j < 0 or parts[j] != right:
            continue
        if skip is not None and skip():
            skipped.append(entry)
            continue
        while skipped:
            heapq.heappush(heap, skipped.pop())
        parts[i], parts[j] = left + right, None
        following[i] = after = following[j]
        if after >= 0:
            previous[after] = i
            offer(i, after)
        if previous[i] >= 0:
            offer(previous[i], i)
    return [p for p in parts if p is not None]


def merge_with_dropout(symbols: list[str], ranks: dict, p: float, key: str) -> list[str]:
    """Like ``merge_symbols``, but each merge is skipped with probability p.
    The coins are hashes of the key and the number of the draw."""
    draws = itertools.count()

    def skip() -> bool:
        digest = hashlib.md5(f"{key}:{next(draws)}".encode(), usedforsecurity=False).digest()
        return int.from_bytes(digest[:4], "big") / 4294967296.0 < p

    return merge_symbols(symbols, ranks, skip if p > 0 else None)


def best_path(word: str, logp: dict, longest: int, unknown: float) -> list[str]:
    """Most likely segmentation of a word under piece log-probabilities; a
    single character outside the vocabulary costs ``unknown``."""
    n = len(word)
    score = [0.0] + [float("-inf")] * n
    start = [0] * (n + 1)
    for end in range(1, n + 1):
        for begin in range(max(0, end - longest), end):
            value = logp.get(word[begin:end])
            if value is None:
                if end - begin > 1:
                    continue
                value = unknown
            if score[begin] + value > score[end]:
                score[end], start[end] = score[begin] + value, begin
    pieces, end = [], n
    while end > 0:
        pieces.append(word[start[end] : end])
        end = start[end]
    return pieces[::-1]
