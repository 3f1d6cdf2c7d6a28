"""Text columns: cleaning, sizes, chunking, codes and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators that also count as blank.
BLANK = r"[\s\x1c-\x1f]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(_col(c), rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def unify_text(df: DataFrame, columns: tuple[str, ...] = ("text", "content")) -> Column:
    """First non-empty of the given columns that ``df`` has, else ''."""
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns if c in df.columns]
    return F.coalesce(*present, F.lit(""))


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Strip the text and drop rows that are blank or null."""
    return df.withColumn(text, strip(text)).filter(F.col(text) != "")


def cleaning_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """How many rows ``clean_text`` keeps and skips."""
    full = F.coalesce(strip(text) != "", F.lit(False))
    return df.agg(F.count_if(full).alias("kept"), F.count_if(~full).alias("skipped"))


def ensure_newline(c: Column | str) -> Column:
    c = _col(c)
    return F.when(F.endswith(c, F.lit("\n")), c).otherwise(F.concat(c, F.lit("\n")))


def utf8_bytes(c: Column | str, with_newline: bool = False) -> Column:
    """UTF-8 length; with ``with_newline`` as if the text ended in one newline."""
    c = _col(c)
    size = F.octet_length(c).cast("bigint")
    if with_newline:
        size = size + F.when(F.endswith(c, F.lit("\n")), 0).otherwise(1)
    return size


def chunk_array(c: Column | str, max_chars: int = 8000) -> Column:
    """Cut at the last space inside each window, hard where there is none.

    Spaces after a cut are skipped. Expects stripped text.
    """
    c = _col(c)
    n = int(max_chars)
    before_space = rf"|.{{1,{n - 1}}}(?= )" if n > 1 else ""
    pattern = rf"(?s)\G *(.{{1,{n}}}\z{before_space}|.{{{n}}})"
    pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.when(F.length(c) <= n, F.array(c)).otherwise(pieces)


def chunk_text(df: DataFrame, text: str = "text", max_chars: int = 8000) -> DataFrame:
    """One row per chunk, with its 0-based ``chunk_no``; a narrow job."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(chunk_array(text, max_chars)).alias("chunk_no", text))


def lang_code_parts(c: Column | str) -> tuple[Column, Column]:
    """``eng_Latn`` -> (``eng``, ``Latn``); the script is null without '_'."""
    parts = F.split(_col(c), "_", 2)
    return F.get(parts, 0), F.get(parts, 1)


def basename(c: Column | str) -> Column:
    return F.substring_index(_col(c), "/", -1)


def stem(c: Column | str, suffix: str = "parquet") -> Column:
    return F.regexp_replace(basename(c), rf"\.{suffix}$", "")


def words(c: Column | str) -> Column:
    """White-space words as an array."""
    return F.regexp_extract_all(_col(c), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(r"(?U)\S+")).cast("bigint")
