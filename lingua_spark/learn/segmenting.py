"""Segmentation of many words side by side, as numpy arrays inside tasks.

The words of a part of the rows are made distinct, each distinct word is
segmented once, and its tokens are copied to all its places. Merges are applied
to all words at once, one merge of each word at a time; unigram paths go through
the lattices of equally long words. Both give what ``merge_symbols`` and
``best_path`` give for a single word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DENSE = 1 << 22  # entries of a plain table
CELLS = 1 << 19  # (word, start, length) cells looked at once
SHORT = 64  # letters of a word taken side by side with others


def slices(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all slices, one slice after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Table:
    """Numbers by pair (a, b) with b < ``width``; ``none`` where there is none."""

    def __init__(self, rows: int, width: int, a: np.ndarray, b: np.ndarray, numbers: np.ndarray, none: int):
        self.width, self.none = width, none
        codes = a.astype(np.int64) * width + b
        self.dense = self.codes = None
        if rows * width <= DENSE:
            self.dense = np.full(max(rows * width, 1), none, np.int32)
            self.dense[codes] = numbers
        else:
            order = np.argsort(codes)
            self.codes, self.numbers = codes[order], np.asarray(numbers, np.int32)[order]

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Only for a and b inside the table."""
        codes = a.astype(np.int64) * self.width + b
        if self.dense is not None:
            return self.dense[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.numbers[at], np.int32(self.none))


class Merges:
    """A list of merges over numbered symbols."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        pairs = sorted(ranks, key=ranks.get)
        self.number = {s: i for i, s in enumerate(dict.fromkeys(s for a, b in pairs for s in (a, b, a + b)))}
        size, get = len(self.number), self.number.__getitem__
        left, right = np.array([get(a) for a, _ in pairs], np.int64), np.array([get(b) for _, b in pairs], np.int64)
        self.size, self.none = size, len(pairs)
        self.made = np.array([get(a + b) for a, b in pairs], np.int64)
        self.table = Table(size, max(size, 1), left, right, np.arange(len(pairs)), self.none) if pairs else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), self.none, np.int32)
        inside = np.flatnonzero((left < self.size) & (right < self.size))
        out[inside] = self.table.get(left[inside], right[inside])
        return out

    def apply(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and sizes of the words after the merges: of each word the
        leftmost pair of the lowest rank is merged, until no word has any."""
        n = len(ids)
        if not n or self.table is None:
            return ids, sizes
        ids, word = ids.copy(), np.repeat(np.arange(len(sizes)), sizes)
        last = np.append(word[1:] != word[:-1], True)
        first = np.append(True, last[:-1])
        following = np.where(last, -1, np.arange(1, n + 1))
        previous = np.where(first, -1, np.arange(-1, n - 1))
        rank, alive = np.full(n, self.none, np.int32), np.ones(n, bool)
        at = np.flatnonzero(~last)
        rank[at] = self.ranks(ids[at], ids[at + 1])
        at = at[rank[at] < self.none]
        while len(at):
            starts = np.flatnonzero(np.diff(word[at], prepend=-1))
            least = np.minimum.reduceat(rank[at], starts)
            counts = np.diff(np.append(starts, len(at)))
            lowest = at[rank[at] == np.repeat(least, counts)]
            place = lowest[np.flatnonzero(np.diff(word[lowest], prepend=-1))]
            gone = following[place]
            ids[place] = self.made[rank[place]]
            alive[gone] = False
            after = following[gone]
            following[place] = after
            previous[after[after >= 0]] = place[after >= 0]
            before = previous[place]
            waiting = at
            rank[place] = rank[gone] = self.none
            touched = np.concatenate([place[after >= 0], before[before >= 0]])
            rank[touched] = self.ranks(ids[touched], ids[following[touched]])
            at = np.unique(np.concatenate([waiting, touched]))
            at = at[rank[at] < self.none]
        return ids[alive], np.bincount(word[alive], minlength=len(sizes))


class Prefixes:
    """What pieces begin with, as numbered states; ``index`` has the numbers of
    the pieces and of all that they begin with, for the latter ``none``."""

    def __init__(self, index: dict[str, int], none: int):
        self.index, self.none = index, none
        state = {"": 0} | {p: i + 1 for i, p in enumerate(index)}
        letters = sorted({p[-1] for p in index})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        place = {c: i for i, c in enumerate(letters)}
        self.dead, width = len(state), max(len(letters), 1)
        self.piece = np.full(self.dead + 1, none, np.int32)
        self.piece[1:-1] = list(index.values())
        old = np.array([state[p[:-1]] for p in index], np.int64)
        letter = np.array([place[p[-1]] for p in index], np.int64)
        self.table = Table(len(state), width, old, letter, np.arange(1, self.dead), self.dead) if index else None

    def letter_numbers(self, words: list[str]) -> np.ndarray:
        """Words by letters, for equally long words; -1 for letters of no piece."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(self.letters):
            return np.full((len(words), len(words[0])), -1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, -1).reshape(len(words), -1)

    def cells(self, letters: np.ndarray, start: int, stop: int, longest: int) -> np.ndarray:
        """Numbers of the pieces by word, start and length - 1."""
        words, n = letters.shape
        cells = np.full((words, stop - start, longest), self.none, np.int32)
        letters = letters[:, start : min(n, stop + longest - 1)]
        places = np.flatnonzero(letters[:, : stop - start].ravel() >= 0)
        row, at = np.divmod(places, stop - start)
        width, flat, out = letters.shape[1], letters.ravel(), cells.ravel()
        here, place, left = row * width + at, places * longest, width - at
        state = np.zeros(len(here), np.int64)
        for k in range(longest):
            if not len(here):
                break
            state = self.table.get(state, flat[here + k])
            alive = state < self.dead
            out[(place + k)[alive]] = self.piece[state[alive]]
            alive &= left > k + 1
            alive[alive] = flat[here[alive] + k + 1] >= 0
            here, place, left, state = here[alive], place[alive], left[alive], state[alive]
        return cells


def numbers(pieces: Iterable[str]) -> dict[str, int]:
    """Pieces with their numbers, then what pieces begin with, numbered as none."""
    index = {p: i for i, p in enumerate(pieces)}
    none = len(index)
    for piece in list(index):
        for k in range(len(piece) - 1, 0, -1):
            if index.setdefault(piece[:k], none) < none:
                break
    return index


class Paths:
    """Most likely paths of many words under log-probabilities of pieces; a
    character outside the vocabulary costs ``unknown``."""

    def __init__(self, logp: dict[str, float], longest: int, unknown: float):
        self.pieces = list(logp)
        self.prefixes = Prefixes(numbers(self.pieces), len(logp))
        self.logp = np.array([*logp.values(), float("-inf")])
        self.longest, self.unknown = longest, unknown

    def equally_long(self, words: list[str]) -> np.ndarray:
        """The numbers of the pieces on the paths by word and start, -1 elsewhere. The number of a character
        outside the vocabulary is that of no piece."""
        n = len(words[0])
        longest, none = min(self.longest, n), self.prefixes.none
        letters = self.prefixes.letter_numbers(words)
        cells = self.prefixes.cells(letters, 0, n, longest)
        logs = self.logp[cells]
        logs[:, :, 0] = np.where(cells[:, :, 0] == none, self.unknown, logs[:, :, 0])
        score = np.full((len(words), n + 1 + longest), float("-inf"))
        score[:, 0] = 0.0
        length = np.ones(score.shape, np.int32)
        sizes = np.arange(1, longest + 1, dtype=np.int32)[None]
        for i in range(n):
            window = slice(i + 1, i + 1 + longest)
            new = score[:, i, None] + logs[:, i]
            better = new > score[:, window]
            score[:, window] = np.where(better, new, score[:, window])
            length[:, window] = np.where(better, sizes, length[:, window])
        on_path = np.full((len(words), n), -1, np.int64)
        row, at = np.arange(len(words)), np.full(len(words), n)
        while len(row):
            size = length[row, at]
            at = at - size
            on_path[row, at] = cells[row, at, size - 1]
            row, at = row[at > 0], at[at > 0]
        return on_path


def symbols_of(words: pa.Array, unit: str, number: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbol numbers of the words and the words' sizes; symbols without a
    number get the next ones."""
    raw = words.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    bounds = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    letters = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    if unit == "byte":
        codes, sizes = letters, np.diff(bounds)
    else:
        codes = np.frombuffer(letters.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
    kinds, places = np.unique(codes, return_inverse=True)
    names = [f"{c:02X}" if unit == "byte" else chr(c).encode("utf-8").hex().upper() for c in kinds.tolist()]
    return np.array([number.setdefault(name, len(number)) for name in names], np.int64)[places], sizes


class Segmenter:
    """Tokens of an array of words by number; ``names`` are the tokens. They
    grow by letters the model has not seen and by the tokens of long words.

    ``at_once`` takes words of at most SHORT letters and gives the tokens'
    numbers and the words' sizes, ``alone`` the tokens of any word.
    """

    def __init__(self, at_once, alone: Callable[[str], list[str]], names: list[str]):
        self.at_once, self.alone, self.names = at_once, alone, names
        self.number = {name: i for i, name in enumerate(names)}

    def numbered(self, tokens: Iterable[str]) -> list[int]:
        known = len(self.number)
        out = [self.number.setdefault(t, len(self.number)) for t in tokens]
        if len(self.number) > known:
            self.names.extend(list(self.number)[known:])
        return out

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        short = (lengths <= SHORT) & (lengths > 0) if self.at_once else np.zeros(len(words), bool)
        taken = words if short.all() else words.filter(pa.array(short))
        ids, sizes = self.at_once(self, taken) if len(taken) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return put_together(words, short, ids, sizes, lambda word: self.numbered(self.alone(word)))


def merge_segmenter(unit: str, ranks: dict[tuple[str, str], int], expansion: dict[str, list[str]], alone) -> Segmenter:
    """Merges lowest rank first, then hidden tokens expanded."""
    merges = Merges(ranks)
    flat, parts = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the tokens of each symbol

    def at_once(seen: Segmenter, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        nonlocal flat, parts
        ids, sizes = symbols_of(words, unit, merges.number)
        ids, sizes = merges.apply(ids, sizes)
        if len(parts) < len(merges.number):
            spelled = [expansion.get(s, (s,)) for s in [*merges.number][len(parts) :]]
            flat = np.append(flat, np.array(seen.numbered(t for tokens in spelled for t in tokens), np.int64))
            parts = np.append(parts, np.array([len(tokens) for tokens in spelled], np.int64))
        starts = np.cumsum(parts) - parts
        ends = np.append(0, np.cumsum(parts[ids]))[np.append(0, np.cumsum(sizes))]
        return flat[slices(starts[ids], parts[ids])], np.diff(ends)

    return Segmenter(at_once, alone, list(merges.number))


def path_segmenter(logp: dict[str, float], longest: int, unknown: float, respell, alone) -> Segmenter:
    """Most likely paths; ``respell`` gives the tokens of a character outside
    the vocabulary."""
    paths = Paths(logp, longest, unknown)

    def at_once(seen: Segmenter, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        listed = words.to_pylist()
        lengths = np.array([len(w) for w in listed])
        sizes, where, found = np.zeros(len(listed), np.int64), [], []
        for n in np.unique(lengths).tolist():
            group = np.flatnonzero(lengths == n)
            width = max(1, CELLS // (n * min(n, longest)))
            for at in range(0, len(group), width):
                some = group[at : at + width]
                on_path = paths.equally_long([listed[i] for i in some])
                row, place = np.nonzero(on_path >= 0)
                ids = on_path[row, place]
                other = np.flatnonzero(ids == len(logp))
                extra = {}
                for k in other.tolist():
                    extra[k] = seen.numbered(respell(listed[some[row[k]]][place[k]]))
                if any(len(e) != 1 for e in extra.values()):
                    parts = np.ones(len(ids), np.int64)
                    parts[other] = [len(extra[k]) for k in other.tolist()]
                    first = np.cumsum(parts) - parts
                    ids, row = np.repeat(ids, parts), np.repeat(row, parts)
                    for k in other.tolist():
                        ids[first[k] : first[k] + parts[k]] = extra[k]
                else:
                    ids[other] = [extra[k][0] for k in other.tolist()]
                sizes[some] = np.bincount(row, minlength=len(some))
                where.append(some[row])
                found.append(ids)
        order = np.argsort(np.concatenate(where), kind="stable")
        return np.concatenate(found)[order], sizes

    return Segmenter(at_once, alone, list(logp))


def put_together(
    words: pa.Array, short: np.ndarray, ids: np.ndarray, sizes: np.ndarray, of_long: Callable[[str], list[int]]
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of all words from those of the short ones."""
    if short.all():
        return ids, sizes
    out_sizes, long = np.zeros(len(words), np.int64), {}
    out_sizes[short] = sizes
    for i in np.flatnonzero(~short).tolist():
        long[i] = of_long(words[i].as_py())
        out_sizes[i] = len(long[i])
    out = np.empty(out_sizes.sum(), np.int64)
    out[np.repeat(short, out_sizes)] = ids
    ends = np.cumsum(out_sizes)
    for i, found in long.items():
        out[ends[i] - len(found) : ends[i]] = found
    return out, out_sizes


def tokens_of_words(words: pa.Array, segment: Segmenter) -> pa.ListArray:
    """The tokens of each word of a column without nulls."""
    return copied_to_rows(pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32), words), segment)


def copied_to_rows(column: pa.ListArray, segment: Segmenter, index: Callable[[str], int] | None = None) -> pa.ListArray:
    """The tokens of each row's words, or with ``index`` their ids; rows without
    words have none."""
    coded = column.flatten().dictionary_encode()
    ids, sizes = segment(coded.dictionary)
    word = coded.indices.to_numpy(zero_copy_only=False)
    taken = ids[slices((np.cumsum(sizes) - sizes)[word], sizes[word])]
    if index is None:
        values = pa.array(segment.names, pa.string()).take(pa.array(taken))
    else:
        values = pa.array(np.array([index(t) for t in segment.names], np.int32)[taken] if len(taken) else taken, pa.int32())
    words = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.append(0, np.cumsum(sizes[word]))[np.append(0, np.cumsum(words))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
