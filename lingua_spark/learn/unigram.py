"""Unigram pieces by expectation maximisation and pruning.

The words become tries of about a million letters, staged once with the state of
an automaton of the seeds at each node (``tries``). A step sends the
log-probabilities of the pieces left and gets back one count per piece; each is
bounded by the seed size, and so is the automaton, which the driver builds.
``Lattices`` give the same sums word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS
from lingua_spark.learn.model import BYTE_PIECES, PieceModel
from lingua_spark.learn.segmenting import CELLS, Prefixes, numbers
from lingua_spark.learn.tries import LETTERS, Automaton, Endings, Paths, Trie, gathered, letters_of, part_counts, tails, trie
from lingua_spark.learn.wordtable import word_counts
from lingua_spark.operators.ordered import block_bounds, cut_at_rank, first_crossing
from lingua_spark.runtime import stage, stage_spread, unstage

PART = 1 << 12  # pieces whose counts are one row
NOTHING = float("-inf")


def substrings(
    words: DataFrame, longest: int = 16, word: str = "word", freq: str = "freq", least: int = 1
) -> DataFrame:
    """All substrings of 1..longest characters with their counts; of longer ones
    than one character those that are counted ``least`` times.

    What the words end in, cut at ``longest``, is sorted by ranges. Substrings are
    what runs of it begin with. Only those that the first or last of a run begins
    with may go on in other runs and are added up by a shuffle.
    """
    rows = words.filter(F.length(word) >= 1).select(F.col(word).alias("word"), F.col(freq).cast("bigint").alias("freq"))

    def cut(batches):
        for table in gathered(batches, "word", LETTERS // 4):
            found = tails(table["word"].chunk(0), table["freq"].to_numpy(), longest)
            yield from found.cast(pa.schema([("tail", pa.string()), ("freq", pa.int64())])).to_batches()

    def count(batches):
        for table in gathered(batches, "tail"):
            pieces, n, whole = part_counts(table["tail"].chunk(0), table["freq"].to_numpy(), least)
            columns = [pieces.cast(pa.string()), pa.array(n), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(columns, ["piece", "n", "whole"])

    ends = rows.mapInArrow(cut, "tail string, freq bigint").repartitionByRange("tail").sortWithinPartitions("tail")
    counted = stage(ends.mapInArrow(count, "piece string, n bigint, whole boolean"), "substrings")
    shared = counted.filter(~F.col("whole")).groupBy("piece").agg(F.sum("n").alias("n"))
    shared = stage(shared.filter((F.length("piece") == 1) | (F.col("n") >= least)), "substrings")
    return counted.filter("whole").select("piece", "n").unionByName(shared)


def seed_pieces(words: DataFrame, size: int = 1_000_000, longest: int = 16) -> DataFrame:
    """Every single character, then the substrings seen twice or more with the
    highest count · length, ``size`` pieces of them.

    Scores are counted first; only the substrings of the last score that is not
    taken whole are put in order, so no task sorts or gathers them all.
    """
    length, score = F.length("piece"), F.col("score")
    counts = substrings(words, longest, least=2).withColumn("score", F.col("n") * length)
    longer = counts.filter(length > 1)
    by_score = longer.groupBy("score").agg(F.count("*").alias("rows"))
    by_score = stage(by_score.select(F.lit(0).alias("_all"), "score", (-score).alias("_falling"), "rows"), "scores")
    target = words.sparkSession.createDataFrame([(0, size - 1)], "_all int, target bigint")
    last = first_crossing(by_score, ["_all"], "_falling", F.col("rows"), target, block_bounds(by_score, "_falling")).first()
    if last is None:  # size 0, or fewer
        return counts if size else counts.filter(length == 1)
    least = -last["cut"]
    room = size - (by_score.filter(score > least).agg(F.sum("rows")).first()[0] or 0)
    code = F.hex(F.encode("piece", "UTF-8"))
    tied = longer.filter(score == least).select(F.lit(0).alias("_all"), code.alias("_code"))
    rank = words.sparkSession.createDataFrame([(0, room)], "_all int, rank bigint")
    cut = cut_at_rank(tied, ["_all"], "_code", rank, block_bounds(tied, "_code")).first()["cut"]
    return counts.filter((length == 1) | (score > least) | ((score == least) & (code <= F.lit(cut))))


def covered_characters(words: DataFrame, coverage: float) -> set[str]:
    """The most frequent characters that make up the share ``coverage`` of all;
    at most as many as Unicode has."""
    single = substrings(words, 1).orderBy(F.desc("n"), F.hex(F.encode("piece", "UTF-8"))).collect()
    total, seen, kept = sum(r["n"] for r in single), 0, set()
    for row in single:
        if seen >= coverage * total:
            break
        seen += row["n"]
        kept.add(row["piece"])
    return kept


def covered_parts(words: DataFrame, kept: set[str]) -> DataFrame:
    """The words cut at characters outside ``kept``, which no piece may hold."""
    shared = words.sparkSession.sparkContext.broadcast(kept)

    @F.pandas_udf("array<string>")
    def parts(column: pd.Series) -> pd.Series:
        inside = shared.value
        return column.map(lambda word: "".join(c if c in inside else "\0" for c in word).split("\0"))

    rows = words.select(F.explode(parts("word")).alias("word"), "freq").filter(F.col("word") != "")
    return rows.groupBy("word").agg(F.sum("freq").alias("freq"))


def digamma(x: np.ndarray) -> np.ndarray:
    value = -sum(1 / (x + m) for m in range(6))
    x = x + 6
    f = 1 / (x * x)
    return value + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252))


def equal_lengths(frame: pd.DataFrame, longest: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of one length at a time, as many as CELLS allows, with their counts."""
    for n, group in frame.groupby(frame["word"].str.len()):
        width = max(1, CELLS // (n * min(n, longest)))
        for at in range(0, len(group), width):
            part = group.iloc[at : at + width]
            yield part["word"].tolist(), part["freq"].to_numpy(float)


class Lattices:
    """The lattices of equally long words: ``cells`` are the numbers of the
    pieces by word, start and length - 1, ``len(logp)`` where there is none.
    ``index`` is what ``numbers`` gives, or its prefixes ready for use.

    A word that is too long for one table of cells is taken in blocks of starts.
    """

    def __init__(self, words: list[str], index: dict[str, int] | Prefixes, logp: np.ndarray, longest: int):
        self.words, self.n = words, len(words[0])
        self.index = Prefixes(index, len(logp)) if isinstance(index, dict) else index
        self.letters = self.index.letter_numbers(words)
        self.longest = min(longest, self.n)
        self.logp, self.none = np.append(logp, NOTHING), len(logp)
        width = max(1, CELLS // (len(words) * self.longest))
        self.blocks = [(s, min(self.n, s + width)) for s in range(0, self.n, width)]
        self.known = self._cells(*self.blocks[0]) if len(self.blocks) == 1 else None

    def _cells(self, start: int, stop: int) -> np.ndarray:
        return self.index.cells(self.letters, start, stop, self.longest)

    def steps(self, backwards: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, cells, log-probabilities) of each block."""
        for start, stop in reversed(self.blocks) if backwards else self.blocks:
            cells = self._cells(start, stop) if self.known is None else self.known
            yield start, cells, self.logp[cells]

    def _table(self, at: int) -> np.ndarray:
        table = np.full((len(self.words), self.n + self.longest + 1), NOTHING)
        table[:, at] = 0.0
        return table

    def expectation(self, freq: np.ndarray) -> tuple[float, np.ndarray]:
        """The log-likelihood and the expected count of each piece. Words that no
        pieces spell add nothing."""
        ahead, back, longest = self._table(0), self._table(self.n), self.longest
        for start, _, logs in self.steps():
            for i in range(logs.shape[1]):
                a = start + i
                reached = ahead[:, a + 1 : a + 1 + longest]
                np.logaddexp(reached, ahead[:, a, None] + logs[:, i], out=reached)
        total = ahead[:, self.n]
        spelled = np.isfinite(total)
        norm = np.where(spelled, total, 0.0)
        counts = np.zeros(len(self.logp))
        for start, cells, logs in self.steps(backwards=True):
            for i in reversed(range(logs.shape[1])):
                a = start + i
                through = logs[:, i] + back[:, a + 1 : a + 1 + longest]
                back[:, a] = np.logaddexp.reduce(through, axis=1)
                logs[:, i] = through + (ahead[:, a] - norm)[:, None]
            weights = np.exp(np.minimum(logs, 0.0)) * np.where(spelled, freq, 0.0)[:, None, None]
            used = weights > 0
            counts += np.bincount(cells[used], weights[used], len(counts))
        return float(norm @ freq), counts[:-1]

    def best(self, freq: np.ndarray) -> np.ndarray:
        """How often each piece is on the words' most likely paths."""
        score, longest = self._table(0), self.longest
        piece = np.full((len(self.words), self.n + 1 + longest), self.none, np.int32)
        length = np.ones_like(piece)
        sizes = np.arange(1, longest + 1, dtype=np.int32)[None]
        for start, cells, logs in self.steps():
            for i in range(logs.shape[1]):
                window = slice(start + i + 1, start + i + 1 + longest)
                new = score[:, start + i, None] + logs[:, i]
                better = new > score[:, window]
                score[:, window] = np.where(better, new, score[:, window])
                piece[:, window] = np.where(better, cells[:, i], piece[:, window])
                length[:, window] = np.where(better, sizes, length[:, window])
        counts = np.zeros(len(self.logp))
        row = np.flatnonzero(np.isfinite(score[:, self.n]))
        at = np.full(len(row), self.n)
        while len(row):
            counts += np.bincount(piece[row, at], freq[row], len(counts))
            at = at - length[row, at]
            row, at = row[at > 0], at[at > 0]
        return counts[:-1]


def _numbered(counts: np.ndarray, **first: float) -> pd.DataFrame:
    used = np.flatnonzero(counts)
    extra = list(first.values())
    return pd.DataFrame({"id": [*range(-len(extra), 0), *used], "n": [*extra, *counts[used]]})


def _expectation(words: DataFrame, index: Broadcast, logp: np.ndarray, longest: int) -> tuple[float, np.ndarray]:
    """One E step: counts are summed per task, then by a shuffle on the number."""
    shared, size = words.sparkSession.sparkContext.broadcast(logp), len(logp)

    def step(frames):
        total, sums = 0.0, np.zeros(size)
        for frame in frames:
            for group, freq in equal_lengths(frame, longest):
                value, counts = Lattices(group, index.value, shared.value, longest).expectation(freq)
                total, sums = total + value, sums + counts
        yield _numbered(sums, total=total)

    rows = words.mapInPandas(step, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    shared.unpersist()
    counts = np.zeros(size)
    pieces = rows[rows["id"] >= 0]
    counts[pieces["id"]] = pieces["n"]
    return float(rows.loc[rows["id"] < 0, "n"].sum()), counts


def _tries(words: DataFrame, automaton: Automaton) -> DataFrame:
    """The words by tries, a row each, with the automaton's state at each node."""
    shared = words.sparkSession.sparkContext.broadcast(automaton)

    def build(batches):
        for table in gathered(batches, "word"):
            letters = letters_of(table["word"].chunk(0))
            nodes = trie(letters.codes(), letters.first)
            freq = table["freq"].to_numpy().astype(float)
            arrays = [nodes.parent, nodes.bounds, nodes.ends, shared.value.states(nodes), freq]
            columns = [pa.array([a.tobytes()], pa.binary()) for a in arrays]
            yield pa.RecordBatch.from_arrays(columns, ["parent", "bounds", "ends", "state", "freq"])

    rows = words.select("word", "freq").repartitionByRange("word").sortWithinPartitions("word")
    fields = "parent binary, bounds binary, ends binary, state binary, freq binary"
    staged = stage(rows.mapInArrow(build, fields), "tries")
    shared.destroy()
    return staged.coalesce(2 * words.sparkSession.sparkContext.defaultParallelism)


def _packed(part: int, counts: np.ndarray) -> tuple[int, bytes, bytes]:
    used = counts != 0
    return part, np.packbits(used).tobytes(), counts[used].tobytes()


def _summed(tries: DataFrame, endings: Endings, method: str) -> tuple[float, np.ndarray]:
    """What a method of ``Paths`` gives, over all tries: the counts of a task are
    rows of up to PART pieces, those that are not zero and which these are; equal
    parts are added up by a shuffle in the order of their tasks."""
    shared = tries.sparkSession.sparkContext.broadcast(endings)

    def step(batches):
        total, sums = 0.0, np.zeros(shared.value.none)
        for batch in batches:
            for row in batch.to_pylist():
                parent, ends, state = (np.frombuffer(row[name], np.int32) for name in ("parent", "ends", "state"))
                nodes = Trie(parent, None, None, np.frombuffer(row["bounds"], np.int64), ends)
                value, counts = getattr(Paths(nodes, state, shared.value), method)(np.frombuffer(row["freq"]))
                total, sums = total + value, sums + counts
        rows = [_packed(-1, np.array([total]))]
        rows += [_packed(at // PART, sums[at : at + PART]) for at in range(0, len(sums), PART)]
        rows = [(part, TaskContext.get().partitionId(), used, n) for part, used, n in rows if n]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows) if rows else [()] * 4, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "task", "used", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                used = np.unpackbits(np.frombuffer(row["used"], np.uint8), count=None).astype(bool)
                part = sums.setdefault(row["part"], np.zeros(PART))
                part[: len(used)][used] += np.frombuffer(row["n"])
        columns = [pa.array(list(sums), pa.int32()), pa.array([n.tobytes() for n in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "n"])

    parts = tries.mapInArrow(step, "part int, task int, used binary, n binary")
    parts = parts.repartition("part").sortWithinPartitions("part", "task")
    total, counts = 0.0, np.zeros(-(-endings.none // PART) * PART)
    for row in parts.mapInArrow(add, "part int, n binary").toArrow().to_pylist():
        if row["part"] < 0:
            total = float(np.frombuffer(row["n"])[0])
        else:
            counts[row["part"] * PART :][:PART] = np.frombuffer(row["n"])
    shared.destroy()
    return total, _steady(counts[: endings.none])


def _steady(values: np.ndarray) -> np.ndarray:
    """Without the last bits, which depend on the order of the summands."""
    part, power = np.frexp(values)
    return np.ldexp(np.round(np.ldexp(part, 36)), power - 36)


def _losses(tries: DataFrame, automaton: Automaton, logp: np.ndarray) -> np.ndarray:
    """What the likelihood loses without a piece: its count on best paths times
    the gap to the best path that replaces it. Single characters lose nothing."""
    endings, nodes = automaton.endings(logp), automaton.nodes
    alive, losses = np.flatnonzero(logp > NOTHING), np.zeros(len(logp))
    _, used = _summed(tries, endings, "best")
    gaps = Paths(nodes, np.arange(len(nodes.parent), dtype=np.int32), endings).gaps()
    losses[alive] = np.where(endings.size[:-1] > 1, used * gaps[nodes.ends[alive]], 0.0)
    return _steady(losses)


def learn_unigram(
    df: DataFrame,
    vocab_size: int,
    text: str = "text",
    preset: str = "words",
    initial_vocab_size: int = 1_000_000,
    max_piece_length: int = 16,
    shrinking_factor: float = 0.75,
    n_sub_iterations: int = 2,
    special_tokens: list[str] | None = None,
    character_coverage: float = 1.0,
    byte_fallback: bool | None = None,
) -> PieceModel:
    """Unigram model: seed substrings, then EM steps and pruning to 75 % by
    turns until the size is reached. Single characters always stay.

    With a coverage below 1 the rarest characters are in no piece. The encoder
    spells them by 256 byte pieces, which count as part of the vocabulary, or as
    <unk> with ``byte_fallback=False``.
    """
    fallback = character_coverage < 1 if byte_fallback is None else byte_fallback
    special = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    words = stage_spread(word_counts(df, text, preset).filter(F.col("word") != ""), "words")
    if character_coverage < 1:
        whole, kept = words, covered_characters(words, character_coverage)
        words = stage_spread(covered_parts(whole, kept), "words")
        whole.unpersist()
    seeds = seed_pieces(words, initial_vocab_size, max_piece_length).select("piece", "score").toArrow().sort_by("piece")
    if not len(seeds):
        return PieceModel(df.sparkSession, {}, preset, special, byte_fallback=fallback)
    pieces, score = seeds["piece"].combine_chunks(), seeds["score"].to_numpy().astype(float)
    single = pc.utf8_length(pieces).to_numpy() == 1
    logp = np.log(score) - np.log(score.sum())
    automaton = Automaton(pieces)
    tries = _tries(words, automaton)
    words.unpersist()
    target = vocab_size - len(special) - len(BYTE_PIECES) * fallback
    history: list[float] = []
    while True:
        for _ in range(n_sub_iterations):
            alive, counts = np.flatnonzero(logp > NOTHING), np.zeros(len(pieces))
            likelihood, counts[alive] = _summed(tries, automaton.endings(logp), "expectation")
            history.append(likelihood)
            counts = np.where(single, np.maximum(counts, 0.5), counts)
            kept = counts >= 0.5
            counts = np.where(kept, counts, 1.0)
            logp = np.where(kept, digamma(counts) - digamma(counts[kept].sum()), NOTHING)
        alive = logp > NOTHING
        if alive.sum() <= max(target, single.sum()):
            break
        losses = _losses(tries, automaton, logp)
        longer = np.flatnonzero(alive & ~single)  # in the order of the pieces
        longer = longer[np.argsort(-losses[longer], kind="stable")]
        room = max(target, int(alive.sum() * shrinking_factor)) - single.sum()
        logp[longer[max(0, room) :]] = NOTHING
    unstage(tries)
    learned = dict(zip(pieces.filter(pa.array(alive)).to_pylist(), logp[alive].tolist()))
    return PieceModel(df.sparkSession, learned, preset, special, history, fallback)
