"""Parity-aware merges: each step serves the language compressed worst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS
from lingua_spark.functions.text import strip
from lingua_spark.learn.batching import Width, epoch
from lingua_spark.learn.bpe import bytes_in_use
from lingua_spark.learn.coded import Coded, coded
from lingua_spark.learn.model import Event, MergeModel
from lingua_spark.learn.wordtable import MergedWords, counted_words, symbol_counts
from lingua_spark.operators.matching import lang_parity_check


def lang_compression(df: DataFrame, tokens, lang: str = "lang", text: str = "text", unit: str = "byte") -> DataFrame:
    """Units (bytes, characters or texts) per token for each language."""
    size = {"byte": F.octet_length(text), "char": F.length(text), "line": F.lit(1)}[unit]
    return df.groupBy(lang).agg(
        F.sum(size).cast("bigint").alias("units"), F.sum(F.size(tokens)).cast("bigint").alias("tokens")
    ).withColumn("compression", F.col("units") / F.col("tokens"))


def _check(train: DataFrame, dev: DataFrame | None, ratio: dict | None, lang: str, order: str, text: str) -> list[str]:
    """Languages by first appearance; the preconditions of a parity run."""
    if dev is None and ratio is None:
        raise ValueError("parity-aware learning needs development texts or target ratios")
    from lingua_spark.operators.corpus import lang_order

    langs = [r[lang] for r in lang_order(train, lang, order, text).orderBy("position").collect()]
    if len(langs) < 2:
        raise ValueError(f"parity-aware learning needs at least two languages, found {langs}")
    if dev is not None and not lang_parity_check(train, dev, lang, order, text).filter(~F.col("matches")).isEmpty():
        raise ValueError("development languages must match the training languages, in the same order")
    return langs


def _symbol_totals(words: Coded) -> dict[str, int]:
    rows = symbol_counts(words, ("lang",)).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    return {r["lang"]: r["n"] for r in rows}


def _parity_loop(
    train: MergedWords,
    dev: MergedWords | None,
    units: dict[str, float],
    langs: list[str],
    n_merges: int,
    min_frequency: int,
    known: list[str],
) -> list[Event]:
    """Epochs over the segments of all languages, of both tables.

    ``units`` over the current symbol count is a language's compression. The
    turn moves to the worst language after every merge; the symbol counts follow
    the merges made in each language's segments.
    """
    events: list[Event] = []
    symbols, width = set(known), Width()
    place = {lang: i for i, lang in enumerate(langs)}
    totals: dict[str, int] = {}
    while len(events) < n_merges:
        found = epoch(train.frame, width, min_frequency, by=("lang",), others=dev.frame if dev else None)
        if found is None:
            break
        now, ranked = found
        open_langs = [lang for (lang,) in ranked]  # the others have no frequent pair left
        totals = totals or _symbol_totals(dev.frame if dev else train.frame)
        merges = []
        while len(events) < n_merges:
            turn = min(open_langs, key=lambda lang: (units[lang] / max(totals.get(lang, 0), 1), place[lang]))
            pair = now.next((turn,), min_frequency)
            if pair is None:
                break
            made = now.merge(pair.left, pair.right)
            for lang in totals:
                totals[lang] -= made.get(("dev", lang) if dev else (lang,), 0)
            merges.append((pair.left, pair.right))
            events.append(Event("+", pair.left, pair.right, pair.n))
            if pair.merged in symbols:
                break
            symbols.add(pair.merged)
        if len(events) < n_merges:
            train.advance(merges)
            if dev and dev is not train:
                dev.advance(merges)
    train.release()
    if dev and dev is not train:
        dev.release()
    return events


def _units(dev: DataFrame | None, train: DataFrame, ratio: dict | None, langs: list[str], unit: str, initial) -> dict:
    """What each language's symbol count is measured against: its texts' size,
    or its initial symbols over the wished ratio."""
    if dev is None:
        return {lang: initial[lang] / ratio[lang] for lang in langs}
    size = {"byte": F.octet_length("text"), "char": F.length("text"), "line": F.lit(1)}[unit]
    rows = dev.groupBy("lang").agg(F.sum(size).alias("n")).collect()
    return {r["lang"]: r["n"] for r in rows}


def learn_parity_bpe(
    train: DataFrame,
    n_merges: int,
    dev: DataFrame | None = None,
    ratio: dict[str, float] | None = None,
    lang: str = "lang",
    order: str = "doc_id",
    text: str = "text",
    preset: str = "whitespace",
    min_frequency: int = 2,
    unit: str = "line",
    preset_phase2: str | None = None,
    phase1_merges: int | None = None,
) -> MergeModel:
    """Parity-aware BPE over at least two languages.

    ``dev`` should hold parallel texts; compression is then texts per token
    (``unit='line'``), for texts that are not parallel choose 'byte'. Without
    it, ``ratio`` gives each language's wished compression of the training
    texts. ``dev`` may be the same DataFrame, whose words are then counted once.
    With ``preset_phase2`` a second phase goes on over coarser
    pre-tokens, after 60 % of the merges unless given.
    """
    langs = _check(train, dev, ratio, lang, order, text)

    def tidy(df: DataFrame) -> DataFrame:
        return df.select(F.col(lang).alias("lang"), strip(text).alias("text")).filter(F.col("text") != "")

    same = dev is train
    train, dev = tidy(train), tidy(dev) if dev is not None else None
    two_phases = preset_phase2 is not None
    first = n_merges if not two_phases else phase1_merges if phase1_merges is not None else int(n_merges * 0.6)

    def tables(name: str, merges: list) -> tuple[MergedWords, MergedWords | None]:
        made = []
        for df in (train, dev):
            if df is None or (made and same):
                made.append(made[0] if same else None)
                continue
            made.append(MergedWords(coded(counted_words(df, "text", name, ("lang",)), merges)))
        return made[0], made[1]

    words, dev_words = tables(preset, [])
    base = bytes_in_use(words.frame)
    units = _units(dev, train, ratio, langs, unit, _symbol_totals(words.frame) if dev is None else None)
    spark = words.frame.sparkSession
    events = _parity_loop(words, dev_words, units, langs, min(first, n_merges), min_frequency, base)
    if two_phases:
        if dev is None:
            raw = counted_words(train, "text", preset_phase2, ("lang",)).groupBy("lang")
            initial = raw.agg(F.sum(F.col("freq") * F.octet_length("word")).alias("n")).collect()
            units = _units(None, train, ratio, langs, unit, {r["lang"]: r["n"] for r in initial})
        words, dev_words = tables(preset_phase2, [(e.left, e.right) for e in events])
        base = sorted(set(base) | set(bytes_in_use(words.frame)))
        known = base + [e.left + e.right for e in events]
        events += _parity_loop(words, dev_words, units, langs, n_merges - len(events), min_frequency, known)
    return MergeModel(spark, base, events, preset_phase2 or preset, "byte", list(SPECIAL_TOKENS))


def learn_parity_super_bpe(train: DataFrame, n_merges: int, **options) -> MergeModel:
    """Phase 1 inside words, phase 2 over whole texts."""
    return learn_parity_bpe(train, n_merges, preset_phase2="text", **options)
