"""Pre-tokenization presets and byte or character symbols.

A pre-token's symbols are kept as one string of bracketed hex codes,
``<74><68><65>``. Merging the pair (74, 68) is then a plain
``replace('<74><68>', '<7468>')``: left to right, without overlaps, and inside
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Split patterns that must equal the published presets.
PRESETS = {
    "byte_level": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "gpt2": r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "gpt4": (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+"
        r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*"
        r"|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    ),
    "gpt4-contractions": (
        r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}"
        r"| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
    ),
    "apertus": (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+"
        r"|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*"
        r"|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    ),
    "superbpe-phase2": r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]{2,}[\r\n/]*| +(?!\S)",
    "apertus-phase2": r"\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+| {2,}(?=\S)|\s+(?!\S)",
}
# Presets that drop white space instead of keeping every character.
SPLITTERS = {
    "whitespace": r"\w+|[^\w\s]+",
    "words": r"\S+",
    # Digits one by one, a space belongs to the word after it.
    "pieces": r"\p{Nd}| ?[^\s\p{Nd}]+|\s",
}
SPECIAL_TOKENS = ["<pad>", "<s>", "</s>", "<unk>", "<mask>"]
# End of fixed values.


def pretokens(c: Column | str, preset: str = "byte_level") -> Column:
    """Array of pre-tokens. ``text`` keeps the text whole; a name outside the
    presets is taken as a regular expression. Matches and the gaps between
    them are both kept, except for the white-space splitters."""
    c = F.col(c) if isinstance(c, str) else c
    if preset == "text":
        return F.when(c.isNotNull(), F.array(c))
    if preset in SPLITTERS:
        pattern = "(?U)" + SPLITTERS[preset]
    else:
        regex = PRESETS.get(preset, preset)
        pattern = rf"(?U)(?s)(?:{regex})|(?:(?!{regex}).)++"
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def pretoken_rows(df: DataFrame, text: str = "text", preset: str = "byte_level") -> DataFrame:
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.explode(pretokens(text, preset)).alias("word"))


def byte_symbols(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "<$1>")


def char_symbols(c: Column | str) -> Column:
    """One symbol per code point, written as the hex of its UTF-8 bytes."""
    c = F.col(c) if isinstance(c, str) else c
    chars = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    coded = F.transform(chars, lambda x: F.hex(F.encode(x, "UTF-8")))
    return F.concat(F.lit("<"), F.array_join(coded, "><"), F.lit(">"))


def symbol_array(symbols: Column | str) -> Column:
    """``<74><68>`` -> ['74', '68']."""
    s = F.col(symbols) if isinstance(symbols, str) else symbols
    return F.split(F.substring(s, F.lit(2), F.length(s) - 2), "><")


def symbol_text(symbol: Column | str) -> Column:
    """The readable form of a symbol; bytes that are no text stay hex."""
    s = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.coalesce(F.try_validate_utf8(F.unhex(s).cast("string")), F.concat(F.lit("0x"), s))


def char_coverage(df: DataFrame, text: str = "text", coverage: float = 1.0) -> DataFrame:
    """Characters by falling frequency with ``kept`` for the smallest prefix
    that reaches the coverage; the others fall back to bytes.

    The window runs over distinct characters, at most the size of Unicode.
    """
    from pyspark.sql import Window

    chars = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"(?sU)\S"), F.lit(0))).alias("ch"))
    counts = chars.groupBy("ch").agg(F.count("*").alias("n"))
    # Codes order alike in every engine, text collations may not.
    counts = counts.withColumn("code", F.hex(F.encode("ch", "UTF-8")))
    order = Window.orderBy(F.desc("n"), F.asc("code"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("code", "n", (before < F.lit(float(coverage)) * total).alias("kept"))
