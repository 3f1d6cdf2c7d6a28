"""Vocabularies without merges: n-grams and LZW phrases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import pretokens
from lingua_spark.learn.context import context_pairs
from lingua_spark.learn.wordtable import windows, word_counts

WINDOW = 256


def ngram_vocab(df: DataFrame, n: int = 3, text: str = "text", preset: str = "words", top: int | None = None) -> DataFrame:
    """All character n-grams of the pre-tokens with their counts; only the
    most frequent on request."""
    words = word_counts(df, text, preset).filter(F.length("word") >= n)
    parts = words.select(F.explode(windows("word", WINDOW, n - 1)).alias("part"), "freq")
    parts = parts.filter(F.length("part") >= n)
    grams = F.transform(
        F.sequence(F.lit(1), F.length("part") - (n - 1)), lambda i: F.substring(F.col("part"), i, F.lit(n))
    )
    counts = parts.select(F.explode(grams).alias("token"), "freq").groupBy("token").agg(F.sum("freq").alias("n"))
    return top_tokens(counts, top) if top else counts


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens; ties by their bytes."""
    return counts.orderBy(F.desc("n"), F.asc(F.hex(F.encode("token", "UTF-8")))).limit(k)


def lzw_phrases(words: list[str]) -> dict[str, int]:
    """Phrases an LZW coder emits over a text's pre-tokens. The dictionary
    starts empty and grows with the text; single characters are always known."""
    known: set[str] = set()
    used: dict[str, int] = {}
    for word in words:
        phrase = ""
        for c in word:
            longer = phrase + c
            if len(longer) == 1 or longer in known:
                phrase = longer
                continue
            used[phrase] = used.get(phrase, 0) + 1
            known.add(longer)
            phrase = c
        if phrase:
            used[phrase] = used.get(phrase, 0) + 1
    return used


def lzw_vocab(df: DataFrame, vocab_size: int, text: str = "text", preset: str = "words") -> DataFrame:
    """Most frequent LZW phrases. One global dictionary would be sequential;
    here each text has its own, and only the sums of the phrase counts are
    limited to ``vocab_size``."""

    def phrases(frames):
        for frame in frames:
            sums: dict[str, int] = {}
            for words in frame["words"]:
                for phrase, n in lzw_phrases([] if words is None else list(words)).items():
                    sums[phrase] = sums.get(phrase, 0) + n
            yield pd.DataFrame({"token": list(sums), "n": list(sums.values())})

    rows = df.select(pretokens(text, preset).alias("words")).mapInPandas(phrases, "token string, n bigint")
    return top_tokens(rows.groupBy("token").agg(F.sum("n").alias("n")), vocab_size)


__all__ = ["context_pairs", "lzw_vocab", "ngram_vocab", "top_tokens"]
