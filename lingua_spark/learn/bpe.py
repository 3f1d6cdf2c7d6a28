"""Merge learners: BPE and its maximum-length, picky, scaffold and trimmed
variants, and two-phase learning across word borders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS
from lingua_spark.learn.batching import Width, clear_leads, epoch, leading_pairs
from lingua_spark.learn.coded import Coded, coded
from lingua_spark.learn.model import Event, MergeModel
from lingua_spark.learn.wordtable import (
    MergedWords,
    counted_words,
    symbol_counts,
    symbol_table,
    word_counts,
)
from lingua_spark.operators.corpus import first_bytes
from lingua_spark.runtime import stage, unstage

def symbol_length(symbol: str, unit: str):
    """Length of a symbol in bytes or characters."""
    if unit == "byte":
        return F.length(symbol) / 2
    return F.length(F.unhex(symbol).cast("string"))


def bytes_in_use(words: Coded) -> list[str]:
    """The alphabet of coded words, whatever was merged."""
    symbols = [r["token"] for r in symbol_counts(words).select("token").collect()]
    return sorted({s[i : i + 2] for s in symbols for i in range(0, len(s), 2)})


def alphabet(table: DataFrame, coverage: float = 1.0) -> list[str]:
    """Base symbols by code: at most 256 bytes, or the characters in use.

    With a coverage below 1 the rarest characters are left out.
    """
    rows = symbol_counts(table).orderBy(F.desc("n"), "token").collect()
    total, seen, kept = sum(r["n"] for r in rows), 0, []
    for row in rows:
        if seen >= coverage * total:
            break
        seen += row["n"]
        kept.append(row["token"])
    return sorted(kept)


def cover(table: DataFrame, kept: list[str]) -> DataFrame:
    """Replace characters outside the alphabet by their bytes."""
    shared = table.sparkSession.sparkContext.broadcast(set(kept))

    @F.pandas_udf("string")
    def covered(column: pd.Series) -> pd.Series:
        inside = shared.value

        def bytes_of(word: str) -> str:
            symbols = word[1:-1].split("><")
            return "><".join(s if s in inside else "><".join(s[i : i + 2] for i in range(0, len(s), 2)) for s in symbols)

        return column.map(lambda word: f"<{bytes_of(word)}>")

    return table.withColumn("syms", covered("syms"))


def short_pairs(max_length: int | None, unit: str):
    """The condition that a pair's symbol is not too long, for Spark and for the driver."""
    if not max_length:
        return None, lambda left, right: True

    def length(symbol: str) -> int:
        return len(symbol) // 2 if unit == "byte" else len(bytes.fromhex(symbol).decode("utf-8", "replace"))

    return (
        symbol_length("left", unit) + symbol_length("right", unit) <= max_length,
        lambda left, right: length(left) + length(right) <= max_length,
    )


def merge_loop(
    words: MergedWords,
    n_merges: int,
    min_frequency: int = 2,
    max_length: int | None = None,
    unit: str = "byte",
    known: list[str] = (),
) -> list[Event]:
    """Epochs of a few jobs each until the merges are made or no pair is
    frequent enough. ``known`` are the symbols that exist beforehand."""
    events: list[Event] = []
    symbols, width = set(known), Width()
    condition, allowed = short_pairs(max_length, unit)
    while len(events) < n_merges:
        width.pairs = min(width.pairs, 2 * (n_merges - len(events)) + 8)
        found = epoch(words.frame, width, min_frequency, condition, allowed)
        if found is None:
            break
        now, merges = found[0], []
        while len(events) < n_merges and (pair := now.next((), min_frequency)):
            now.merge(pair.left, pair.right)
            merges.append((pair.left, pair.right))
            events.append(Event("+", pair.left, pair.right, pair.n))
            if pair.merged in symbols:
                break
            symbols.add(pair.merged)
        if len(events) < n_merges:
            words.advance(merges)
    words.release()
    return events


def text_loop(words: MergedWords, n_merges: int, min_frequency: int, known: list[str]) -> list[Event]:
    """The same over whole texts, whose segments are too many to be fetched: each
    pass counts all pairs and makes the merges that no other can overtake."""
    events: list[Event] = []
    symbols, most = set(known), 64
    while len(events) < n_merges:
        ranked = leading_pairs(words.frame, most, min_frequency).get((), [])
        merges = []
        for pair in clear_leads(ranked, len(ranked) < most)[: n_merges - len(events)]:
            merges.append((pair.left, pair.right))
            events.append(Event("+", pair.left, pair.right, pair.n))
            if pair.merged in symbols:
                break
            symbols.add(pair.merged)
        if not merges:
            break
        if len(events) < n_merges:
            words.advance(merges)
    words.release()
    return events


def learn_bpe(
    df: DataFrame,
    vocab_size: int | None = None,
    n_merges: int | None = None,
    text: str = "text",
    preset: str = "byte_level",
    unit: str = "byte",
    min_frequency: int = 2,
    max_type_length: int | None = None,
    character_coverage: float = 1.0,
    special_tokens: list[str] | None = None,
    counts: DataFrame | None = None,
) -> MergeModel:
    """BPE to a vocabulary size (special tokens, base symbols, merges) or to a
    number of merges. ``unit='char'`` starts from characters and falls back to
    bytes below the character coverage. ``counts`` are the ``word_counts`` of
    the texts under the preset, if they are known already."""
    special = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    if unit == "byte":
        words = MergedWords(coded(counted_words(df, text, preset, counts=counts)))
        base = bytes_in_use(words.frame)
    else:
        table = symbol_table(df, text, preset, unit=unit, counts=counts)
        if character_coverage < 1:
            table = stage(table, "symbols")
            table = cover(table, alphabet(table, character_coverage))
        words = MergedWords(table)
        base = alphabet(words.frame)
    if n_merges is None:
        n_merges = max(0, vocab_size - len(special) - len(base))
    events = merge_loop(words, n_merges, min_frequency, max_type_length, unit, base)
    return MergeModel(df.sparkSession, base, events, preset, unit, special)


def learn_picky_bpe(
    df: DataFrame,
    vocab_size: int | None = None,
    n_events: int | None = None,
    threshold: float = 0.5,
    text: str = "text",
    preset: str = "byte_level",
    min_frequency: int = 2,
    max_type_length: int | None = 16,
    special_tokens: list[str] | None = None,
) -> MergeModel:
    """BPE that removes a token once most of its occurrences go into a merge:
    if count(pair) / count(token) reaches the threshold, what is left of the
    token is split again. Base symbols stay."""
    special = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    words = MergedWords(coded(counted_words(df, text, preset)))
    base = bytes_in_use(words.frame)
    made: dict[str, tuple[str, str]] = {}
    events: list[Event] = []
    alive = set(base)

    def full() -> bool:
        if n_events is not None:
            return len(events) >= n_events
        return len(special) + len(alive) >= vocab_size

    width, known = Width(), set(base)
    condition, allowed = short_pairs(max_type_length, "byte")
    while not full():
        found = epoch(words.frame, width, min_frequency, condition, allowed)
        if found is None:
            break
        now, merges, replaced = found[0], [], []
        counts = vocabulary_counts(words.frame)
        while not full() and (pair := now.next((), min_frequency)):
            before = {s: counts[s] for s in (pair.left, pair.right)}
            count_merge(counts, pair, now.merge(pair.left, pair.right).get((), 0))
            merges.append((pair.left, pair.right))
            made[pair.merged] = (pair.left, pair.right)
            alive.add(pair.merged)
            events.append(Event("+", pair.left, pair.right, pair.n))
            splitting = [
                s
                for s in dict.fromkeys((pair.left, pair.right))
                if s in made and s != pair.merged and pair.n / before[s] >= threshold
            ]
            while splitting:
                token = splitting.pop(0)
                left, right = made[token]
                replaced.append((f"<{token}>", f"<{left}><{right}>"))
                alive.discard(token)
                events.append(Event("-", left, right))
                # A part removed earlier must not come back.
                splitting += [s for s in dict.fromkeys((left, right)) if s not in alive]
            if replaced or pair.merged in known:
                break  # a split token's other occurrences are in no segment
            known.add(pair.merged)
        if not full():
            words.advance(merges, replaced)
    words.release()
    return MergeModel(df.sparkSession, base, events, preset, "byte", special)


def vocabulary_counts(symbols: DataFrame | Coded) -> dict[str, int]:
    """Occurrences of each symbol; as many rows as the vocabulary has so far."""
    return {r["token"]: r["n"] for r in symbol_counts(symbols).collect()}


def count_merge(counts: dict[str, int], pair, made: int) -> None:
    """Follow the occurrences of symbols through a merge."""
    counts[pair.left] -= made
    counts[pair.right] -= made
    counts[pair.merged] = counts.get(pair.merged, 0) + made


def learn_scaffold_bpe(
    df: DataFrame,
    vocab_size: int | None = None,
    n_merges: int | None = None,
    text: str = "text",
    preset: str = "byte_level",
    min_frequency: int = 2,
    max_type_length: int | None = 16,
    special_tokens: list[str] | None = None,
) -> MergeModel:
    """BPE whose tokens count only while they are at least as frequent as the
    next candidate pair, at the end the one that would be merged next. Rarer ones become scaffolds: merges still go through
    them, but the encoder expands them."""
    special = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    words = MergedWords(coded(counted_words(df, text, preset)))
    base = bytes_in_use(words.frame)
    events: list[Event] = []
    made: set[str] = set()  # tokens made by merges
    scaffolds: set[str] = set()

    def full() -> bool:
        if n_merges is not None:
            return len(events) >= n_merges
        return len(special) + len(base) + len(made) - len(scaffolds) >= vocab_size

    width, known = Width(), set(base)
    condition, allowed = short_pairs(max_type_length, "byte")
    while True:
        found = epoch(words.frame, width, min_frequency, condition, allowed)
        if found is None:
            break
        now, merges = found[0], []
        counts = vocabulary_counts(words.frame)
        while pair := now.next((), min_frequency):
            scaffolds = {t for t in made if counts.get(t, 0) < pair.n}
            if full():
                break
            count_merge(counts, pair, now.merge(pair.left, pair.right).get((), 0))
            merges.append((pair.left, pair.right))
            made.add(pair.merged)
            events.append(Event("+", pair.left, pair.right, pair.n))
            if pair.merged in known:
                break
            known.add(pair.merged)
        if pair and full():
            break
        words.advance(merges)
    words.release()
    return MergeModel(df.sparkSession, base, events, preset, "byte", special, hidden=scaffolds)


def token_counts(model: MergeModel, df: DataFrame, text: str = "text", counts: DataFrame | None = None) -> DataFrame:
    """Corpus counts of a model's tokens: each distinct word segmented once."""
    words = (word_counts(df, text, model.preset) if counts is None else counts).filter(F.col("word") != "")
    rows = model.segment_words(words).select(F.explode("tokens").alias("token"), "freq")
    return rows.groupBy("token").agg(F.sum("freq").alias("n"))


def trim_bpe(
    model: MergeModel, df: DataFrame, min_count: int, text: str = "text", counts: DataFrame | None = None
) -> MergeModel:
    """Take tokens seen fewer than ``min_count`` times out of a vocabulary; the
    encoder decomposes them until only kept tokens are left.

    The comparison is a join with the vocabulary; what comes back is bounded
    by its size.
    """
    merged = [t for t in model.tokens if t not in set(model.alphabet)]
    vocab = model.spark.createDataFrame([(t,) for t in merged], "token string")
    found = vocab.join(token_counts(model, df, text, counts), "token", "left").fillna({"n": 0})
    rare = {r["token"] for r in found.filter(F.col("n") < min_count).collect()}
    return MergeModel(
        model.spark, model.alphabet, model.events, model.preset, model.unit, model.special, hidden=model.hidden | rare
    )


def learn_trimmed_bpe(
    df: DataFrame, vocab_size: int | None = None, n_merges: int | None = None, min_count: int = 100, text: str = "text", **options
) -> MergeModel:
    """The words are counted once, for the merges and for their tokens."""
    counts = stage(word_counts(df, text, options.get("preset", "byte_level")), "word_counts")
    model = trim_bpe(learn_bpe(df, vocab_size, n_merges, text, counts=counts, **options), df, min_count, text, counts)
    unstage(counts)
    return model


def learn_super_bpe(
    df: DataFrame,
    vocab_size: int | None = None,
    n_merges: int | None = None,
    phase1_merges: int | None = None,
    text: str = "text",
    preset: str = "gpt4",
    preset_phase2: str = "superbpe-phase2",
    min_frequency: int = 2,
    special_tokens: list[str] | None = None,
    merges: list[tuple[str, str]] | None = None,
    num_bytes: int | None = None,
    order: str = "doc_id",
) -> MergeModel:
    """Two phases: merges inside words, then, on coarser pre-tokens, merges
    across them. Phase 2 starts from the replayed first merges (60 % unless
    given), either learned here or the first of ``merges``, pairs of symbols
    from an earlier model, which then have no counts. With ``num_bytes`` only
    the first texts by ``order`` that fit into so many bytes are learned from."""
    if num_bytes is not None:
        df = stage(first_bytes(df, num_bytes, order, text).select(text), "first_bytes")
    special = list(SPECIAL_TOKENS if special_tokens is None else special_tokens)
    first = phase1_merges if phase1_merges is not None else int((vocab_size or n_merges) * 0.6)
    if merges is None:
        model = learn_bpe(
            df, n_merges=first, text=text, preset=preset, min_frequency=min_frequency, special_tokens=special
        )
        learned, letters = model.events, set(model.alphabet)
    else:
        learned = [Event("+", left, right) for left, right in merges]
        letters = {s for pair in merges for s in pair} - {left + right for left, right in merges}
    counts = counted_words(df, text, preset_phase2)
    if n_merges is None:  # the base symbols decide how many merges there are
        plain = coded(counts)
        base = sorted(letters | set(bytes_in_use(plain)))
        n_merges = max(0, vocab_size - len(special) - len(base))
        words = MergedWords(plain.merged([[(e.left, e.right) for e in learned[: min(first, n_merges)]]]))
    else:
        words = MergedWords(coded(counts, [(e.left, e.right) for e in learned[: min(first, n_merges)]]))
        base = sorted(letters | set(bytes_in_use(words.frame)))
    inherited = learned[: min(first, n_merges)]
    known = base + [e.left + e.right for e in inherited]
    loop = text_loop if preset_phase2 == "text" else merge_loop
    events = inherited + loop(words, n_merges - len(inherited), min_frequency, known=known)
    return MergeModel(df.sparkSession, base, events, preset_phase2, "byte", special)
