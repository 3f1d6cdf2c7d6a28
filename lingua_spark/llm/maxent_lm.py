"""Language-model scores from a hashed maximum-entropy model.

A token's probability is split in its class, its place in the class, and, for
rare tokens, its share of that place:

    P(w | history) = P(class | history) * P(place | class, history) * P(w | place)

Classes. The most frequent words, with half of all occurrences, lie in classes of
about equal mass by frequency; the others, unseen ones included, in classes by
their last two bytes. The end of a text is a class of its own. A place is one of
the ``head_words`` most frequent words of at most 64 bytes, or all other words
with the same class and hash, which have their smoothed shares there.

Both softmaxes are conditional on the history. Logits of classes come from hashed
features of the classes before, and both get weights of hashed features of the
words before: the previous word (bigram), the one before it (skip) and both
(trigram). Rarer words than the head stand in a history as their class and hash.
So that normalising needs no sum over a class of thousands, the softmax of classes
and that inside each class run down a binary tree, a Huffman tree inside. Without
weights they give the class softmax and the smoothed shares of the counts.

Training. Counts of (history of classes, class) are sufficient statistics of the
class features: one pass counts them and gradient updates run over this table.
Weights of words are fitted by generalized iterative scaling: a pass over all
training texts sums, for each hashed weight, how often its decisions were taken
and how often the model expects them; the table of sums has a fixed size, is
added up by a shuffle, and moves the weights. By default there is one pass. Texts are taken in small sparse
batches of tokens. Sums do not depend on how texts are split up, except for
rounding.

Scoring. Words outside the head are shuffled by word to the counts and their
logarithms summed per row. Everything else is done on the byte buffers of whole
batches with numpy.

Defined cases: null texts count as empty and still have their end token; a null
key counts as held out; repeated rows are scored one by one; without training
texts every token gets the same score; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import frugal, stage

SMOOTH = 0.1
CLASSES = 32  # class 0 is the end of a text, and stands before its start
SPREAD = 8  # hash values of a previous token within its class
HISTORIES = CLASSES * SPREAD * CLASSES
FREQUENT = 15  # classes by frequency; those above are classes by ending
SHARED = CLASSES * SPREAD  # places of rare words; those above are head words
DEPTH = CLASSES.bit_length() - 1  # decisions between classes
TOKENS_AT_ONCE = 1 << 13
PACKED = 1 << 26  # two counts below it share one double
BLOCKS = 16  # parts of the table of sums

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Training:
    """``features`` rows of class weights; ``steps`` gradient updates at rate
    ``rate`` with a Gaussian prior of ``prior`` pseudo-counts; 2 to the power of
    ``bits`` weights of words, moved in ``passes`` passes by one ``share``-th, each
    with ``pseudo`` decisions as the model expects them; ``head_words`` bounds the
    table of words that every task holds."""

    features: int = 1 << 14
    steps: int = 24
    rate: float = 0.7
    prior: float = 1.0
    bits: int = 20
    passes: int = 1
    share: float = 1.5
    pseudo: float = 10.0
    head_words: int = 200_000
    flush_words: int = 400_000


def held_out(key: Column) -> Column:
    """Every tenth row by the checksum of its key."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


# Tokens of batches


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow array, and where each begins and ends."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def word_shapes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and hash (below SPREAD) of each word, and words before each text."""
    inside = ~_BLANK[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    low = _LOWER[raw].astype(np.int64)
    size = last - first + 1
    tail = low[last] * 256 + np.where(size > 1, low[np.maximum(last - 1, 0)], 0)
    kinds = 1 + (tail * 40503 >> 7) % (CLASSES - 1)
    front = low[first] * 65537 + np.where(size > 2, low[np.minimum(first + 2, len(raw) - 1)], 0) * 257 + size
    return kinds, (front * 2654435761 >> 13) % SPREAD, np.searchsorted(first, bounds)


def rare_class(kinds: np.ndarray) -> np.ndarray:
    """Classes of words outside the head, by their ending."""
    return FREQUENT + 1 + (kinds - 1) % (CLASSES - 1 - FREQUENT)


def classed_tokens(
    raw: np.ndarray, bounds: np.ndarray, ids: np.ndarray | None = None, lexicon: Lexicon | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History and class of each token, ends of texts included, and the first
    token of each text. Without the words' ``ids`` classes are those by ending."""
    kinds, hashes, before = word_shapes(raw, bounds)
    if lexicon is not None:
        kinds = rare_class(kinds)
        head = ids >= 0
        own = lexicon.shapes[SHARED + ids[head]]
        kinds[head] = own // SPREAD
    n = len(bounds) - 1
    starts = before[:-1] + np.arange(n)
    total = len(kinds) + n
    is_end = np.zeros(total, bool)
    is_end[before[1:] + np.arange(n)] = True
    classes, spread = np.zeros(total, np.int64), np.zeros(total, np.int64)
    classes[~is_end], spread[~is_end] = kinds, hashes
    own = classes * SPREAD + spread
    previous, earlier = np.zeros(total, np.int64), np.zeros(total, np.int64)
    previous[1:], earlier[2:] = own[:-1], classes[:-2]
    previous[starts], earlier[starts] = 0, 0  # before a text there is its start
    second = starts[starts + 1 < total] + 1
    earlier[second] = 0
    return previous * CLASSES + earlier, classes, starts


def words_of_batch(texts: pa.Array) -> Iterator[list[bytes]]:
    for text in texts:
        raw = text.as_buffer()
        yield raw.to_pybytes().lower().split() if raw else []


# Words, their classes and places


@dataclass(frozen=True)
class Lexicon:
    """Head words and the tree of places. ``shapes`` has the class and hash of each
    place in a history. The way to a place is the part of ``steps`` between two
    entries of ``begin``, first through the classes; a step is twice its node plus
    the branch. ``offsets`` are the log odds of the steps without a history,
    ``masses`` the log10 of what the words of a place share, 0 for a head word's."""

    ids: dict[bytes, int]
    logs: list[float]
    shapes: np.ndarray
    begin: np.ndarray
    steps: np.ndarray
    offsets: np.ndarray
    masses: np.ndarray


def frequency_classes(counts: np.ndarray, kinds: np.ndarray, total: int) -> np.ndarray:
    """Classes of head words, the most frequent first; ``total`` occurrences of all."""
    middle = np.cumsum(counts) - counts / 2
    bins = (middle * (2 * FREQUENT / max(total, 1))).astype(np.int64)
    return np.where(bins < FREQUENT, 1 + bins, kinds)


def huffman(masses: list[float], first: int) -> tuple[list[list[int]], list[float]]:
    """Steps to each leaf below one root, and log odds of nodes from ``first`` on."""
    heap = [(m, i) for i, m in enumerate(masses)]
    heapq.heapify(heap)
    children, odds = [], []
    while len(heap) > 1:
        (m0, left), (m1, right) = heapq.heappop(heap), heapq.heappop(heap)
        children.append((left, right))
        odds.append(math.log(m1 / m0))
        heapq.heappush(heap, (m0 + m1, len(masses) + len(children) - 1))
    ways: list[list[int]] = [[] for _ in range(len(masses) + len(children))]
    for at in range(len(children) - 1, -1, -1):
        way = ways[len(masses) + at]
        for branch, child in enumerate(children[at]):
            ways[child] = [*way, 2 * (first + at) + branch]
    return ways[: len(masses)], odds


def lexicon_of(words: list[tuple[bytes, int, int]], shared: dict[int, tuple[int, int]], total: int) -> Lexicon:
    """From head words with counts and places by shape, and occurrences and
    distinct words of the shared places."""
    words = sorted(words, key=lambda w: (-w[1], w[0]))
    counts = np.array([n for _, n, _ in words], np.int64)
    by_shape = np.array([p for _, _, p in words], np.int64)
    classes = frequency_classes(counts, by_shape // SPREAD, total)
    masses = np.zeros(SHARED + len(words))
    for place in range((FREQUENT + 1) * SPREAD, SHARED):
        n, distinct = shared.get(place, (0, 0))
        masses[place] = n + SMOOTH * (distinct + 1)
    masses[SHARED:] = counts + SMOOTH
    class_of = np.concatenate([np.arange(SHARED) // SPREAD, classes])
    ways: list[list[int]] = [[] for _ in masses]
    offsets = [0.0] * CLASSES  # nodes of classes have their odds from the history
    order = np.argsort(class_of, kind="stable")
    for kind, members in zip(range(CLASSES), np.split(order, np.searchsorted(class_of[order], np.arange(1, CLASSES)))):
        members = members[masses[members] > 0]
        top = [2 * ((CLASSES + kind) >> d + 1) + (kind >> d & 1) for d in range(DEPTH - 1, -1, -1)]
        below, odds = huffman(masses[members].tolist(), len(offsets))
        offsets += odds
        for place, way in zip(members.tolist(), below):
            ways[place] = top + way
        if not kind:
            ways[0] = top  # the end of a text
    begin = np.zeros(len(ways) + 1, np.int64)
    np.cumsum([len(w) for w in ways], out=begin[1:])
    steps = np.fromiter((s for w in ways for s in w), np.int32, int(begin[-1]))
    logs = np.zeros(len(masses))
    used = masses[:SHARED] > 0
    logs[:SHARED][used] = np.log10(masses[:SHARED][used])
    return Lexicon(
        {w: i for i, (w, _, _) in enumerate(words)},
        [math.log10(n + SMOOTH) for _, n, _ in words],
        np.concatenate([np.arange(SHARED), classes * SPREAD + by_shape % SPREAD]),
        begin, steps, np.array(offsets, np.float32)[steps >> 1], logs,
    )


def placed_tokens(texts: pa.Array, ids: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Place of each token, and the first token of each text."""
    history, classes, starts = classed_tokens(*buffers(texts), ids, lexicon)
    places = np.zeros(len(classes), np.int32)
    words = np.flatnonzero(classes)
    # class and hash of a word stand in the history of the token after it
    places[words] = np.where(ids >= 0, SHARED + ids, history[words + 1] // CLASSES)
    return places, starts


def batch_of_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of all texts of a batch, and where each text starts."""
    raw, bounds = buffers(column)
    return np.frombuffer(raw, np.int32).astype(np.int64), bounds[:-1] // 4


def before_tokens(places: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places one and two before each token, 0 before a text."""
    previous, earlier = np.zeros_like(places), np.zeros_like(places)
    previous[1:], earlier[2:] = places[:-1], places[:-2]
    previous[starts], earlier[starts] = 0, 0
    earlier[starts[starts + 1 < len(places)] + 1] = 0
    return previous, earlier


def class_histories(previous: np.ndarray, earlier: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """As ``classed_tokens`` has them."""
    return lexicon.shapes[previous] * CLASSES + lexicon.shapes[earlier] // SPREAD


def word_features(previous: np.ndarray, earlier: np.ndarray) -> list[np.ndarray]:
    """Hashes of the bigram, skip and trigram features."""
    features = [previous * 3 + 1, earlier * 3 + 2, (previous * 1_000_003 + earlier) * 3]
    return [(f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32) for f in features]


def decisions(
    places: np.ndarray, previous: np.ndarray, earlier: np.ndarray, lexicon: Lexicon,
    odds: np.ndarray, weights: np.ndarray | None, bits: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First decision of each token; branch, log odds and weights of each decision.

    ``odds`` are those of the nodes of classes after each history of classes;
    ``weights``, 2 to the power of ``bits``, are all zero before the first pass.
    """
    begin = lexicon.begin.take(places)
    sizes = lexicon.begin.take(places + 1) - begin
    first = np.cumsum(sizes) - sizes
    at = np.repeat(begin - first, sizes)
    at += np.arange(len(at))
    steps = lexicon.steps.take(at)
    logits = lexicon.offsets.take(at)
    top = first[:, None] + np.arange(DEPTH)
    history = class_histories(previous, earlier, lexicon)
    logits[top] = odds.take((history * CLASSES)[:, None] + (steps.take(top) >> 1))
    mixed = (steps >> 1).astype(np.uint32)
    mixed *= np.uint32(0x9E3779B1)
    cells = []
    for feature in word_features(previous, earlier):
        cell = np.repeat(feature, sizes)
        cell ^= mixed
        cell *= np.uint32(0x85EBCA6B)
        cell >>= np.uint32(32 - bits)
        cell = cell.astype(np.int64)
        if weights is not None:
            logits += weights.take(cell, mode="clip")
        cells.append(cell)
    return first, steps & 1, logits, cells


def class_odds(logs: np.ndarray) -> np.ndarray:
    """Log odds of the upper half of the classes below each node, from the
    logarithms of the classes' probabilities."""
    level, out = logs, np.zeros(logs.shape, np.float32)
    while level.shape[1] > 1:
        half = level.shape[1] // 2
        out[:, half : 2 * half] = level[:, 1::2] - level[:, ::2]
        level = np.logaddexp(level[:, ::2], level[:, 1::2])
    return out.ravel()


def fit_words(training: DataFrame, shared_lexicon, shared_odds, options: Training) -> np.ndarray:
    """Weights of the hashed word features, by iterative scaling over all texts."""
    spark = training.sparkSession
    bits, size = options.bits, 1 << options.bits
    block = size // BLOCKS
    weights = np.zeros(size, np.float32)

    def sums_of(shared, tables: int):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, odds, current = Lexicon(**shared_lexicon.value), shared_odds.value, shared.value
            sums, packed, room = np.zeros((tables, size)), np.zeros(size, np.complex128), PACKED

            def unpack() -> None:
                sums[0] += packed.imag
                if tables > 1:
                    taken = np.floor(packed.real / PACKED)
                    sums[1] += taken
                    sums[2] += packed.real - taken * PACKED
                packed[:] = 0

            for batch in batches:
                places, starts = batch_of_places(batch.column(0))
                previous, earlier = before_tokens(places, starts)
                for at in range(0, len(places), TOKENS_AT_ONCE):
                    some = slice(at, at + TOKENS_AT_ONCE)
                    _, branch, logits, cells = decisions(
                        places[some], previous[some], earlier[some], lexicon, odds, current, bits
                    )
                    if room < len(branch) * len(cells):
                        unpack()
                        room = PACKED
                    room -= len(branch) * len(cells)
                    values = np.empty(len(branch), np.complex128)
                    values.imag = 1 / (1 + np.exp(-logits))
                    values.real = branch * float(PACKED) + 1
                    for cell in cells:
                        np.add.at(packed, cell, values)
            unpack()
            if sums.any():
                parts = [sums[:, b * block : (b + 1) * block].astype(np.float32).tobytes() for b in range(BLOCKS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names=["block", "sums"]
                )

        return part

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, some in zip(batch.column("block").to_pylist(), batch.column("sums")):
                values = np.frombuffer(some.as_buffer(), np.float32).astype(np.float64)
                total[number] = total[number] + values if number in total else values
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())],
            names=["block", "sums"],
        )

    taken, times = np.zeros(size), np.zeros(size)
    for step in range(options.passes):
        shared = spark.sparkContext.broadcast(weights if step else None)
        parts = (
            training.mapInArrow(sums_of(shared, 1 if step else 3), "block int, sums binary")
            .repartition(BLOCKS, "block")
            .mapInArrow(added, "block int, sums binary")
        )
        expected = np.zeros(size)
        for row in parts.collect():  # one row per block, the table's size in all
            sums = np.frombuffer(row["sums"]).reshape(-1, block)
            where = slice(row["block"] * block, (row["block"] + 1) * block)
            expected[where] = sums[0]
            if not step:
                taken[where], times[where] = sums[1:]
        shared.destroy()
        weights = weights + scaling(taken, expected, times, options).astype(np.float32)
    return weights


def scaling(taken: np.ndarray, expected: np.ndarray, times: np.ndarray, options: Training) -> np.ndarray:
    """What iterative scaling adds to each weight: its part of the logarithm by
    which the odds taken differ from those expected."""
    share = np.clip(expected / np.maximum(times, 1), 1e-6, 1 - 1e-6)
    upper = taken + options.pseudo * share
    lower = times - taken + options.pseudo * (1 - share)
    return np.where(times > 0, np.log(upper / lower) - np.log(share / (1 - share)), 0.0) / options.share


# Counting


def count_words(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    """Word, place by its shape and count, summed over a task's texts."""
    seen: Counter[bytes] = Counter()

    def drain() -> Iterator[pa.RecordBatch]:
        words = list(seen)
        for at in range(0, len(words), 65_536):
            some = words[at : at + 65_536]
            column = pa.array(some, pa.binary())
            kinds, hashes, _ = word_shapes(*buffers(column))
            places = rare_class(kinds) * SPREAD + hashes
            yield pa.RecordBatch.from_arrays(
                [column, pa.array(places.astype(np.int32)), pa.array([seen[w] for w in some], pa.int64())],
                names=["word", "place", "n"],
            )
        seen.clear()

    for batch in batches:
        for words in words_of_batch(batch.column(0)):
            seen.update(words)
            if len(seen) >= flush:
                yield from drain()
    yield from drain()


def count_histories(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """History, class and count, summed over the places of a task's texts."""
    cells = np.zeros(HISTORIES * CLASSES, np.int64)
    for batch in batches:
        if batch.num_rows:
            places, starts = batch_of_places(batch.column(0))
            history = class_histories(*before_tokens(places, starts), lexicon)
            cells += np.bincount(history * CLASSES + lexicon.shapes[places] // SPREAD, minlength=len(cells))
    found = np.flatnonzero(cells)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array((found // CLASSES).astype(np.int32)),
            pa.array((found % CLASSES).astype(np.int32)),
            pa.array(cells[found]),
        ],
        names=["history", "class", "n"],
    )


# The softmax over classes


def features_of(histories: np.ndarray, size: int) -> np.ndarray:
    """Four rows of weights for each history: bias, bigram, skip, trigram."""
    previous, earlier = histories // CLASSES, histories % CLASSES
    mixed = [
        np.zeros_like(histories),
        1 + previous,
        7_000_003 + earlier,
        13_000_027 + histories,
    ]
    return np.stack([(m.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(size) for m in mixed], 1).astype(np.int64)


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    logits = weights[rows].sum(1)
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def train(cells: DataFrame, options: Training) -> np.ndarray:
    """Natural logarithms of P(class | history), HISTORIES x CLASSES.

    ``cells`` holds at most HISTORIES x CLASSES counts. Each update sends the
    weights out, sums the gradient per task and adds the tasks' sums up.
    """
    spark = cells.sparkSession
    tasks = 4  # the table is of fixed size, and so is the number of its parts
    table = stage(
        cells.groupBy("history").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("counts"))
        .repartition(tasks, "history"),
        "maxent_cells",
    )
    size, classes = options.features, CLASSES
    weights = np.zeros((size, classes))
    squares = np.zeros((size, classes))

    def gradient(shared):
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current = shared.value
            total, tokens = np.zeros((size, classes)), 0.0
            for batch in batches:
                histories = batch.column("history").to_numpy().astype(np.int64)
                if not len(histories):
                    continue
                counts = np.zeros((len(histories), classes))
                for i, pairs in enumerate(batch.column("counts").to_pylist()):
                    for kind, n in pairs:
                        counts[i, kind] = n
                rows = features_of(histories, size)
                logs = log_softmax(current, rows)
                slope = counts - counts.sum(1, keepdims=True) * np.exp(logs)
                for k in range(rows.shape[1]):
                    np.add.at(total, rows[:, k], slope)
                tokens += counts.sum()
            used = np.flatnonzero(total.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([used.tobytes()]), pa.array([total[used].astype(np.float32).tobytes()]), pa.array([tokens])],
                names=["used", "total", "tokens"],
            )

        return part

    for _ in range(options.steps):
        slope, tokens = np.zeros((size, classes)), 0.0
        shared = spark.sparkContext.broadcast(weights.astype(np.float32))
        parts = table.coalesce(tasks).mapInArrow(gradient(shared), "used binary, total binary, tokens double")
        for row in parts.collect():  # one row per task, each at most as large as the weights
            used = np.frombuffer(row["used"], np.int32)
            slope[used] += np.frombuffer(row["total"], np.float32).reshape(-1, classes)
            tokens += row["tokens"]
        shared.destroy()
        if not tokens:
            break
        slope = (slope - options.prior * weights) / tokens
        squares += slope * slope
        weights = weights + options.rate * slope / (np.sqrt(squares) + 1e-9)
    rows = features_of(np.arange(HISTORIES, dtype=np.int64), size)
    return log_softmax(weights, rows)


# Scoring


def log_shares(
    places: np.ndarray, starts: np.ndarray, lexicon: Lexicon, odds: np.ndarray, weights: np.ndarray
) -> np.ndarray:
    """log10 of each token's probability, for rare words without their counts."""
    previous, earlier = before_tokens(places, starts)
    out = -lexicon.masses[places]
    for at in range(0, len(places), TOKENS_AT_ONCE):
        some = slice(at, at + TOKENS_AT_ONCE)
        first, branch, logits, _ = decisions(
            places[some], previous[some], earlier[some], lexicon, odds, weights, len(weights).bit_length() - 1
        )
        logits *= 1 - 2 * branch.astype(np.float32)  # log odds of the other branch
        lost = np.maximum(logits, 0) + np.log1p(np.exp(-np.abs(logits)))
        out[some] -= np.add.reduceat(lost, first, dtype=np.float64) / math.log(10)
    return out


def score(docs: DataFrame, options: Training = Training(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` with token counts, the unigram score and the model's score.

    Both are log10 probabilities of the whole text, trained on the rows that
    are not held out.
    """
    spark = docs.sparkSession
    frugal(spark)
    raw = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), held_out(F.col(key)).alias("held_out"))
    training = raw.filter("not held_out").select("text")
    flush = options.flush_words
    counts = stage(
        training.mapInArrow(lambda it: count_words(it, flush), "word binary, place int, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.max("place").alias("place")),
        "maxent_words",
    )
    ends = training.count()
    occurrences, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = ends + occurrences, vocabulary + (ends > 0)
    log_all = math.log10(tokens + SMOOTH * (distinct + 1))
    end_log = math.log10(ends + SMOOTH)

    least = head_count(counts, options.head_words)
    in_head = (F.col("n") >= least) & (F.octet_length("word") <= 64)
    head = [(bytes(r["word"]), r["n"], r["place"]) for r in counts.filter(in_head).toLocalIterator()]
    tail = counts.filter(~in_head)
    per_place = tail.groupBy("place").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    lexicon = lexicon_of(head, {r["place"]: (r["n"], r["v"]) for r in per_place}, occurrences)
    shared_lexicon = spark.sparkContext.broadcast(vars(lexicon))  # workers may not have this module

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(**shared_lexicon.value)
        get, head_logs = lexicon.ids.get, lexicon.logs
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch.column("text")
            ids, logs_of, known, rare = [], np.empty(n), np.empty(n, np.int64), []
            for i, words in enumerate(words_of_batch(texts)):
                found = [get(w, -1) for w in words]
                ids += found
                hits = [head_logs[v] for v in found if v >= 0]
                missing = Counter([w for w, v in zip(words, found) if v < 0]) if len(hits) < len(found) else {}
                logs_of[i] = math.fsum(hits) + end_log
                known[i] = len(hits) + (ends > 0)
                rare.append(list(missing.items()))
            places, starts = placed_tokens(texts, np.array(ids, np.int64), lexicon)
            stops = np.append(starts[1:], len(places))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("held_out"),
                    pa.array((stops - starts).astype(np.int64)),
                    pa.array(known),
                    pa.array(logs_of),
                    pa.array([places[i:j].tobytes() for i, j in zip(starts, stops)], pa.binary()),
                    pa.array(rare, RARE),
                ],
                names=["key", "held_out", "n_tokens", "known", "logs", "places", "rare"],
            )

    kind = dict(raw.dtypes)["key"]
    rows = stage(
        raw.mapInArrow(
            coded,
            f"key {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, places binary, "
            "rare map<binary, bigint>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "maxent_rows",
    )
    learnt = rows.filter("not held_out").select("places")
    cells = stage(
        learnt.mapInArrow(
            lambda it: count_histories(it, Lexicon(**shared_lexicon.value)), "history int, class int, n bigint"
        )
        .groupBy("history", "class")
        .agg(F.sum("n").alias("n")),
        "maxent_histories",
    )
    shared_odds = spark.sparkContext.broadcast(class_odds(train(cells, options)))
    shared_weights = spark.sparkContext.broadcast(fit_words(learnt, shared_lexicon, shared_odds, options))

    def modelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, odds, weights = Lexicon(**shared_lexicon.value), shared_odds.value, shared_weights.value
        for batch in batches:
            if batch.num_rows:
                places, starts = batch_of_places(batch.column("places"))
                sums = np.add.reduceat(log_shares(places, starts, lexicon, odds, weights), starts)
                columns = [batch.column(c) for c in MODELLED] + [pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, names=[*MODELLED, "model"])

    rare = rows.select("row", F.explode("rare").alias("word", "times"))
    tail_sums = (
        rare.join(tail.select("word", "n"), "word")
        .groupBy("row")
        .agg(
            F.sum("times").alias("tail_known"),
            F.sum(F.col("times") * F.log10(F.col("n") + SMOOTH)).alias("tail_logs"),
        )
    )
    scored = rows.select(
        "key", "held_out", "n_tokens", "known", "logs", "row",
        F.aggregate(F.map_values("rare"), F.lit(0).cast("bigint"), lambda a, b: a + b).alias("rare_tokens"),
        "places",
    ).mapInArrow(
        modelled,
        f"key {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, row bigint, rare_tokens bigint, "
        "model double",
    )
    joined = scored.join(tail_sums, "row", "left").fillna({"tail_known": 0, "tail_logs": 0.0})
    unseen = (F.col("rare_tokens") - F.col("tail_known")) * math.log10(SMOOTH)
    logs_all = F.col("logs") + F.col("tail_logs") + unseen
    return joined.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("tail_known")).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (logs_all - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model") + F.col("tail_logs") + unseen).alias("score"),
    )


RARE = pa.map_(pa.binary(), pa.int64())
MODELLED = ["key", "held_out", "n_tokens", "known", "logs", "row", "rare_tokens"]


def head_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` words reach it."""
    kept, least = 0, None
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        if kept + row["count"] > most:
            break
        kept, least = kept + row["count"], row["n"]
    return least if least is not None else 1 << 62
