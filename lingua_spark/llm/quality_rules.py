"""Quality rules by compression bands.

Repetitive text compresses too well and noise too badly. Each text is
compressed with zstandard as a whole and in fixed chunks; the ratio of plain to
compressed bytes must lie in a band that depends on the length, because short
texts carry the frame's fixed cost and long ones find more matches. Whole
documents show repetition over long distances, chunks show a bad stretch that a
long text would hide. Two plain word rules come first.

The work is map-only: one Arrow function over the text column, no shuffle.

Defined cases: a null text counts as empty; a text without words fails the
minimum of words; nothing depends on other rows, so repeated rows and empty
tables need no care, and columns of the caller keep their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import frugal, words_of

SYMBOLS = re.compile(r"[#*$%&|<>]")


@dataclass(frozen=True)
class Bands:
    """Limits on plain bytes over compressed bytes.

    ``whole`` has (least bytes, lowest ratio, highest ratio) in rising order of
    size; the last entry at or below the text's size holds. ``chunk`` is the
    band of a chunk of ``chunk_bytes``; a text fails if more than
    ``bad_share`` of its chunked bytes lie outside. A last chunk below
    ``least_chunk`` is too short for the band and is left to the whole ratio.
    """

    whole: tuple[tuple[int, float, float], ...] = field(
        default=(
            (0, 0.0, 3.0),
            (128, 0.8, 3.0),
            (256, 1.05, 3.5),
            (1024, 1.3, 4.5),
            (8192, 1.4, 6.0),
            (65536, 1.5, 8.0),
        )
    )
    chunk: tuple[float, float] = (1.3, 5.0)
    chunk_bytes: int = 4096
    least_chunk: int = 2048
    bad_share: float = 0.3
    level: int = 3
    least_words: int = 10
    most_repeated_percent: int = 20
    window: int = 5


def repeated_words(words: list[bytes], window: int) -> int:
    """Word positions covered by a window of words that occurs again.

    Windows get exact numbers by doubling: a window's number is the rank of the
    pair (number of its front part, number of its last word). Memory stays at a
    few integers per word however long the text is.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    runs = ids[:n]
    for k in range(1, window):
        _, runs = np.unique(runs * len(number) + ids[k : k + n], return_inverse=True)
    starts = np.flatnonzero(np.bincount(runs)[runs] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    filled = [line for line in lines if line.strip(" \t\n\v\f\r")]
    return len(filled) - len(set(filled))


def in_bands(raw: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of bytes in bad chunks, the verdict."""
    if not raw:
        return 0.0, 0.0, False
    ratio = len(raw) / len(compressor.compress(raw))
    low, high = next((lo, hi) for least, lo, hi in reversed(bands.whole) if len(raw) >= least)
    seen = bad = 0
    for at in range(0, len(raw), bands.chunk_bytes):
        piece = raw[at : at + bands.chunk_bytes]
        if len(piece) < bands.least_chunk:
            break
        seen += len(piece)
        part = len(piece) / len(compressor.compress(piece))
        bad += 0 if bands.chunk[0] <= part <= bands.chunk[1] else len(piece)
    share = bad / seen if seen else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


def judge(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = words_of(text)
    repeated = repeated_words(words, bands.window)
    failed = len(words) < bands.least_words or 100 * repeated > bands.most_repeated_percent * len(words)
    ratio, share, fits = in_bands(raw, bands, compressor)
    return (
        len(words),
        sum(1 for byte in b"".join(words) if byte & 0xC0 != 0x80) if not raw.isascii() else sum(map(len, words)),
        len(SYMBOLS.findall(text)),
        duplicate_lines(text),
        repeated,
        failed,
        ratio,
        share,
        fits and not failed,
    )


RESULT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, bad_chunk_share double, kept boolean"
)
NAMES = [part.split()[0] for part in RESULT.split(", ")]


def quality_column(text, bands: Bands = Bands()):
    """The verdict on a text column as one struct column."""

    @F.pandas_udf(RESULT)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            yield pd.DataFrame([judge(t, bands, compressor) for t in texts], columns=NAMES)

    return verdicts(F.col(text) if isinstance(text, str) else text)


def quality(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """``doc_id`` with counts, ratios and the verdict of each document."""
    frugal(docs.sparkSession)
    judged = docs.select("doc_id", quality_column("text", bands).alias("verdict"))
    return judged.select("doc_id", "verdict.*")


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    frugal(docs.sparkSession)
    return docs.filter(quality_column(docs["text"], bands)["kept"])
