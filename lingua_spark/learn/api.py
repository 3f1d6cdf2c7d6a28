"""One entry point for all learners, and the protocol for a user's own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame

from lingua_spark.learn import bpe, context, parity, phrases, unigram


class Trainer(Protocol):
    """A learner takes a DataFrame of texts, not a path, and returns a model
    with ``tables()`` or, for plain vocabularies, a DataFrame."""

    def __call__(self, df: DataFrame, vocab_size: int, **options): ...


def _char_bpe(df: DataFrame, vocab_size: int, **options):
    return bpe.learn_bpe(df, vocab_size, unit="char", **{"preset": "pieces", **options})


def _max_length_bpe(df: DataFrame, vocab_size: int, **options):
    return bpe.learn_bpe(df, vocab_size, **{"max_type_length": 16, **options})


def _dropout_bpe(df: DataFrame, vocab_size: int, dropout_probability: float = 0.1, **options):
    model = _max_length_bpe(df, vocab_size, **options)
    model.dropout = dropout_probability
    return model


def _pieces(df: DataFrame, vocab_size: int, **options):
    return unigram.learn_unigram(df, vocab_size, **{"preset": "pieces", **options})


def _ngrams(df: DataFrame, vocab_size: int | None = None, n: int = 3, **options):
    """All n-grams: the vocabulary size is no limit here."""
    return phrases.ngram_vocab(df, n, **options)


def _sage(df: DataFrame, vocab_size: int, initial_vocab_size: int | None = None, text: str = "text", **options):
    """A larger vocabulary (by a third unless given) pruned to ``vocab_size``;
    the encoder spells pruned tokens by their parts."""
    model = bpe.learn_bpe(df, initial_vocab_size or -(-vocab_size * 4 // 3), text=text)
    return context.prune(model, df, vocab_size, text, context.ContextOptions(**options))[0]


TRAINERS: dict[str, Callable] = {
    "bpe": bpe.learn_bpe,
    "char-bpe": _char_bpe,
    "classic-bpe": _max_length_bpe,
    "picky-bpe": bpe.learn_picky_bpe,
    "scaffold-bpe": bpe.learn_scaffold_bpe,
    "trimmed-bpe": bpe.learn_trimmed_bpe,
    "bpe-dropout": _dropout_bpe,
    "superbpe": bpe.learn_super_bpe,
    "unigram": unigram.learn_unigram,
    "piece-unigram": _pieces,
    "kudopiece": _pieces,
    "pa-bpe": parity.learn_parity_bpe,
    "pa-super-bpe": parity.learn_parity_super_bpe,
    "ngram": _ngrams,
    "lzw": phrases.lzw_vocab,
    "sage": _sage,
}


def fit(df: DataFrame, algorithm: str | Trainer, vocab_size: int, **options):
    """Learn a tokenizer by algorithm name or with a user's own trainer."""
    trainer = TRAINERS.get(algorithm) if isinstance(algorithm, str) else algorithm
    if trainer is None:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {sorted(TRAINERS)}")
    return trainer(df, vocab_size, **options)
