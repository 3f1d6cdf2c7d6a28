"""Learned tokenizers: tables to store and encoders to apply."""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS, pretokens
from lingua_spark.functions.segmentation import best_path, merge_symbols, merge_with_dropout
from lingua_spark.learn.segmenting import Segmenter, copied_to_rows, merge_segmenter, path_segmenter, tokens_of_words

BYTE_PIECES = [f"<0x{b:02X}>" for b in range(256)]
MEMO = 1 << 16  # words remembered per task
MEMO_LENGTH = 64  # longer ones are segmented each time
PART = 1 << 20  # letters segmented before their tokens leave the task


def remembered(segment):
    """``segment`` with a bounded memory for short words."""
    short = lru_cache(MEMO)(segment)
    return lambda word: short(word) if len(word) <= MEMO_LENGTH else segment(word)


def all_words(words, of_word) -> list:
    """The results for the words of a text in a row; none for a null text."""
    return [] if words is None else [x for w in words for x in of_word(w)]


def row_parts(words: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Places and numbers of rows with about PART letters; a longer one is alone."""
    flat = words.values
    offsets = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset :] if len(flat) else np.zeros(1, np.int32)
    ends = offsets[words.offsets.to_numpy()[1:]].astype(np.int64) if len(words) else np.zeros(0, np.int64)
    part = (ends - (ends[0] if len(ends) else 0)) // PART
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for at, to in zip(starts, np.append(starts[1:], len(words))):
        yield int(at), int(to - at)


def mapped_words(of_text, as_tokens: bool, words: Column, key: Column | None = None) -> Column:
    """``of_text()`` makes a function of a text's key and words, applied to
    every row; null texts have the words None.

    A batch of rows holds very many words, so it is taken in parts: only one
    part's words and tokens are Python objects at a time.
    """
    kind = pa.list_(pa.string() if as_tokens else pa.int32())

    def encode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encoded = of_text()
        for keys, column in batches:
            if not len(column):
                yield pa.array([], kind)
            for at, n in row_parts(column):
                rows = zip(keys.slice(at, n).to_pylist(), column.slice(at, n).to_pylist())
                yield pa.array([encoded(row, words) for row, words in rows], kind)

    encode.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(encode, "array<string>" if as_tokens else "array<int>")
    return udf(F.lit(None).cast("string") if key is None else key, words)


def mapped_distinct(segmenter_of_task, as_tokens: bool, words: Column) -> Column:
    """``segmenter_of_task()`` makes a segmenter and a token's id, applied to
    the distinct words of parts of the rows; null texts have no tokens."""
    kind = pa.list_(pa.string() if as_tokens else pa.int32())

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segment, index = segmenter_of_task()
        for column in batches:
            if not len(column):
                yield pa.array([], kind)
            for at, n in row_parts(column):
                yield copied_to_rows(column.slice(at, n), segment, None if as_tokens else index).cast(kind)

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<string>" if as_tokens else "array<int>")(words)


def initial_symbols(word: str, unit: str) -> list[str]:
    if unit == "byte":
        return [f"{b:02X}" for b in word.encode("utf-8")]
    return [c.encode("utf-8").hex().upper() for c in word]


@dataclass
class Event:
    """A merge ('+') or the removal of a token ('-') into left and right."""

    kind: str
    left: str
    right: str
    n: int = 0


@dataclass
class MergeModel:
    """A merge-based tokenizer over hex symbols."""

    spark: SparkSession
    alphabet: list[str]
    events: list[Event]
    preset: str = "byte_level"
    unit: str = "byte"
    special: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))
    hidden: set[str] = field(default_factory=set)  # merged over, never emitted
    dropout: float = 0.0

    @property
    def merges(self) -> list[tuple[str, str]]:
        return [(e.left, e.right) for e in self.events if e.kind == "+"]

    @property
    def tokens(self) -> list[str]:
        """Emitted tokens in id order, without the special ones."""
        alive = dict.fromkeys(self.alphabet)
        for e in self.events:
            if e.kind == "+":
                alive[e.left + e.right] = None
            else:
                alive.pop(e.left + e.right, None)
        return [t for t in alive if t not in self.hidden]

    @property
    def vocab_size(self) -> int:
        return len(self.special) + len(self.tokens)

    def merges_table(self) -> DataFrame:
        rows = [(i, e.left, e.right, e.n) for i, e in enumerate(e for e in self.events if e.kind == "+")]
        return self.spark.createDataFrame(rows, "rank int, left string, right string, n bigint")

    def events_table(self) -> DataFrame:
        rows = [(i, e.kind, e.left, e.right) for i, e in enumerate(self.events)]
        return self.spark.createDataFrame(rows, "step int, kind string, left string, right string")

    def vocab_table(self) -> DataFrame:
        """Special tokens as text, all others as hex symbols."""
        names = [*self.special, *self.tokens]
        rows = [(t, i, None) for i, t in enumerate(names)]
        return self.spark.createDataFrame(rows, "token string, id int, logp double")

    def tables(self) -> dict[str, DataFrame]:
        return {
            "merges": self.merges_table(),
            "events": self.events_table(),
            "vocab": self.vocab_table(),
            "settings": self.settings_table(),
        }

    def settings_table(self) -> DataFrame:
        """What the other tables do not tell, as JSON by name."""
        rows = [
            ("kind", json.dumps("merges")),
            ("alphabet", json.dumps(self.alphabet)),
            ("special", json.dumps(self.special)),
            ("hidden", json.dumps(sorted(self.hidden))),
            ("preset", json.dumps(self.preset)),
            ("unit", json.dumps(self.unit)),
            ("dropout", json.dumps(self.dropout)),
        ]
        return self.spark.createDataFrame(rows, "name string, value string")

    def parents(self) -> dict[str, tuple[str, str]]:
        made: dict[str, tuple[str, str]] = {}
        for left, right in self.merges:
            made.setdefault(left + right, (left, right))
        return made

    def expansion(self) -> dict[str, list[str]]:
        """Hidden token -> the emitted tokens it stands for."""
        parents, out = self.parents(), {}

        def expand(token: str) -> list[str]:
            if token not in self.hidden:
                return [token]
            if token not in out:
                left, right = parents[token]
                out[token] = expand(left) + expand(right)
            return out[token]

        for token in self.hidden:
            expand(token)
        return out

    def _plan(self) -> tuple:
        """Plain data from which a task builds its segmenter."""
        if any(e.kind == "-" for e in self.events):
            return self.unit, None, [(e.kind, e.left, e.right) for e in self.events], {}
        return self.unit, self._ranks(), None, self.expansion()

    def _ranks(self) -> dict[tuple[str, str], int]:
        ranks: dict[tuple[str, str], int] = {}
        for i, merge in enumerate(self.merges):
            ranks.setdefault(merge, i)
        return ranks

    def encode(
        self,
        df: DataFrame,
        text: str = "text",
        out: str = "input_ids",
        as_tokens: bool = False,
        dropout: float | None = None,
        key: str = "doc_id",
        seed: int = 42,
    ) -> DataFrame:
        """Add the ids (or hex tokens) of each text; a null text has none.

        Map-only: the pre-tokens come from the JVM, each task segments the
        distinct words of a part of its rows at once; the model is broadcast, bounded by its
        vocabulary. Bytes or characters outside the vocabulary get <unk>. A
        model learned with dropout encodes with it unless ``dropout`` says
        otherwise.
        """
        dropout = self.dropout if dropout is None else dropout
        if dropout > 0:
            return self.encode_dropout(df, dropout, seed, key, text, out, as_tokens)
        shared = self.spark.sparkContext.broadcast((self._plan(), self._ids()))
        unknown = self._unknown()

        def of_task():
            plan, index = shared.value
            return side_by_side(plan), lambda token: index.get(token, unknown)

        return df.withColumn(out, mapped_distinct(of_task, as_tokens, pretokens(text, self.preset)))

    def encode_dropout(
        self,
        df: DataFrame,
        p: float | None = None,
        seed: int = 42,
        key: str = "doc_id",
        text: str = "text",
        out: str = "tokens",
        as_tokens: bool = True,
    ) -> DataFrame:
        """Stochastic segmentation: every possible merge is skipped with
        probability p (the model's own unless given), reproducibly per (seed,
        row key, word place)."""
        p = self.dropout if p is None else p
        shared = self.spark.sparkContext.broadcast((self._ranks(), self.expansion(), self._ids()))
        unit, unknown = self.unit, self._unknown()

        def of_text():
            ranks, expansion, index = shared.value

            def encoded(row, words) -> list:
                tokens = [
                    t
                    for place, w in enumerate([] if words is None else words)
                    for s in merge_with_dropout(initial_symbols(w, unit), ranks, p, f"{seed}:{row}:{place}")
                    for t in expansion.get(s, (s,))
                ]
                return tokens if as_tokens else [index.get(t, unknown) for t in tokens]

            return encoded

        words = pretokens(text, self.preset)
        return df.withColumn(out, mapped_words(of_text, as_tokens, words, F.col(key).cast("string")))

    def _ids(self) -> dict[str, int]:
        return {t: i + len(self.special) for i, t in enumerate(self.tokens)}

    def _unknown(self) -> int:
        return self.special.index("<unk>") if "<unk>" in self.special else -1

    def segment_words(self, words: DataFrame, word: str = "word", out: str = "tokens") -> DataFrame:
        """Segment a table of distinct words, each once."""
        shared = self.spark.sparkContext.broadcast(self._plan())

        def segment_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            segment = side_by_side(shared.value)
            for column in batches:
                yield tokens_of_words(column, segment)

        segment_column.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return words.withColumn(out, F.arrow_udf(segment_column, "array<string>")(word))


def segmenter(plan: tuple):
    """A function word -> emitted symbols."""
    unit, ranks, events, expansion = plan
    if events is not None:
        replay = EventReplay(events)
        return lambda word: replay.apply(initial_symbols(word, unit))

    def segment(word: str) -> list[str]:
        symbols = merge_symbols(initial_symbols(word, unit), ranks)
        if expansion:
            symbols = [t for s in symbols for t in expansion.get(s, (s,))]
        return symbols

    return segment


def side_by_side(plan: tuple) -> Segmenter:
    """The same for arrays of words; removals are replayed word by word."""
    unit, ranks, events, expansion = plan
    alone = remembered(segmenter(plan))
    return Segmenter(None, alone, []) if events is not None else merge_segmenter(unit, ranks, expansion, alone)


class EventReplay:
    """Merges and removals applied in the order they were learned.

    A token's place is its offset in the word's hex string, which neither a
    merge nor a removal changes. Each place waits in a heap for the next event
    that touches it; of one event the leftmost place goes first, as in a scan
    of the word. Events that a change only later makes possible are past.
    """

    def __init__(self, events: list[tuple[str, str, str]]):
        self.merge_at: dict[tuple[str, str], list[int]] = {}
        self.split_at: dict[str, list[int]] = {}
        self.events = events
        for i, (kind, left, right) in enumerate(self.events):
            if kind == "+":
                self.merge_at.setdefault((left, right), []).append(i)
            else:
                self.split_at.setdefault(left + right, []).append(i)

    def apply(self, symbols: list[str]) -> list[str]:
        token, previous, at = {}, {}, 0
        last = -1
        for s in symbols:
            token[at], previous[at] = s, last
            last, at = at, at + len(s)
        end, waiting = at, []

        def wait(steps: list[int] | None, place: int, now: int) -> None:
            step = bisect_left(steps, now) if steps else 0
            if steps and step < len(steps):
                heapq.heappush(waiting, (steps[step], place))

        def pair(place: int, now: int) -> None:
            """The place and its follower may be merged from ``now`` on."""
            following = place + len(token[place])
            if following < end:
                wait(self.merge_at.get((token[place], token[following])), place, now)

        for place in token:
            pair(place, 0)
            wait(self.split_at.get(token[place]), place, 0)
        while waiting:
            step, place = heapq.heappop(waiting)
            kind, left, right = self.events[step]
            middle, behind = place + len(left), place + len(left) + len(right)
            if kind == "+" and token.get(place) == left and token.get(middle) == right:
                del token[middle], previous[middle]
                token[place] = left + right
                changed = [place]
            elif kind == "-" and token.get(place) == left + right:
                token[place], token[middle], previous[middle] = left, right, place
                changed = [place, middle]
            else:
                continue
            if behind < end:
                previous[behind] = changed[-1]
            for new in changed:
                pair(new, step + 1)
                wait(self.split_at.get(token[new]), new, step + 1)
            if previous[place] >= 0:
                pair(previous[place], step + 1)
        return [token[place] for place in sorted(token)]


def spelled(character: str) -> list[str]:
    return [BYTE_PIECES[b] for b in character.encode("utf-8", "surrogatepass")]


@dataclass
class PieceModel:
    """A unigram tokenizer: pieces with log-probabilities, and with a byte
    fallback the 256 byte pieces between special tokens and pieces."""

    spark: SparkSession
    logp: dict[str, float]
    preset: str = "words"
    special: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))
    history: list[float] = field(default_factory=list)  # log-likelihood per EM step
    byte_fallback: bool = False

    @property
    def fixed(self) -> list[str]:
        """Tokens without a probability."""
        return [*self.special, *(BYTE_PIECES if self.byte_fallback else [])]

    @property
    def vocab_size(self) -> int:
        return len(self.fixed) + len(self.logp)

    def vocab_table(self) -> DataFrame:
        pieces = sorted(self.logp.items(), key=lambda kv: (-kv[1], kv[0]))
        rows = [(t, i, None) for i, t in enumerate(self.fixed)]
        rows += [(t, i + len(self.fixed), p) for i, (t, p) in enumerate(pieces)]
        return self.spark.createDataFrame(rows, "token string, id int, logp double")

    def tables(self) -> dict[str, DataFrame]:
        rows = [
            ("kind", json.dumps("pieces")),
            ("special", json.dumps(self.special)),
            ("preset", json.dumps(self.preset)),
            ("byte_fallback", json.dumps(self.byte_fallback)),
        ]
        settings = self.spark.createDataFrame(rows, "name string, value string")
        return {"vocab": self.vocab_table(), "settings": settings}

    def encode(self, df: DataFrame, text: str = "text", out: str = "input_ids", as_tokens: bool = False) -> DataFrame:
        """Ids (or pieces) of the most likely segmentation of each text.

        Map-only, words remembered. A null text has none; a character outside
        the vocabulary gets its bytes or, without the fallback, <unk>.
        """
        longest = max((len(t) for t in self.logp), default=1)
        costly = min(self.logp.values(), default=0.0) - 10.0
        pieces = sorted(self.logp, key=lambda t: (-self.logp[t], t))
        ids = {t: i for i, t in enumerate([*self.fixed, *pieces])}
        fallback = self.byte_fallback
        unknown = self.special.index("<unk>") if "<unk>" in self.special else -1
        shared = self.spark.sparkContext.broadcast((self.logp, ids))

        def of_task():
            logp, index = shared.value

            def respell(character: str) -> list[str]:
                return spelled(character) if fallback else [character]

            def alone(word: str) -> list[str]:
                path = best_path(word, logp, longest, costly)
                return [t for p in path for t in ([p] if p in logp else respell(p))]

            segment = path_segmenter(logp, longest, costly, respell, alone)
            return segment, lambda token: index.get(token, unknown)

        return df.withColumn(out, mapped_distinct(of_task, as_tokens, pretokens(text, self.preset)))


def read_tokenizer(spark: SparkSession, path: str) -> MergeModel | PieceModel:
    """A model from the tables that ``write_tokenizer`` wrote; their size is
    bounded by the vocabulary."""
    settings = {r["name"]: json.loads(r["value"]) for r in spark.read.parquet(f"{path}/settings").collect()}
    if settings["kind"] == "pieces":
        rows = spark.read.parquet(f"{path}/vocab").filter("logp is not null").collect()
        logp = {r["token"]: r["logp"] for r in rows}
        fallback = settings.get("byte_fallback", False)
        return PieceModel(spark, logp, settings["preset"], settings["special"], byte_fallback=fallback)
    counts = {r["rank"]: r["n"] for r in spark.read.parquet(f"{path}/merges").collect()}
    events, rank = [], 0
    for row in spark.read.parquet(f"{path}/events").orderBy("step").collect():
        made = row["kind"] == "+"
        events.append(Event(row["kind"], row["left"], row["right"], counts[rank] if made else 0))
        rank += made
    return MergeModel(
        spark,
        settings["alphabet"],
        events,
        settings["preset"],
        settings["unit"],
        settings["special"],
        set(settings["hidden"]),
        settings["dropout"],
    )
