"""Projections, filters and pre-tokenization."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingua_spark.functions import pretok, text
from lingua_spark.learn.wordtable import pair_counts, symbol_table, word_counts
from lingua_spark.queries.registry import query, table

BLANK_SQL = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# White-space splitter in a dialect without Unicode \w.
WORD_OR_MARKS = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]+"
GPT2_COLLAPSED = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


@query(
    "unify_text",
    """
    SELECT doc_id, CASE WHEN lang = 'en' THEN text WHEN lang = 'de' THEN '' ELSE upper(source) END AS text
    FROM documents
    """,
)
def unify_text(spark, folder):
    docs = table(spark, folder, "documents")
    wide = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", F.col("text")).when(F.col("lang") == "de", "").alias("text"),
        F.when(F.col("lang") != "de", F.upper("source")).alias("content"),
    )
    return wide.select("doc_id", text.unify_text(wide).alias("text"))


@query(
    "clean_text",
    rf"""
    SELECT doc_id, regexp_replace(t, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g') AS text
    FROM (SELECT doc_id, CASE WHEN source = 'src3' THEN chr(160) || ' ' || chr(10)
                              ELSE chr(160) || chr(9) || text || ' ' || chr(8195) END AS t FROM documents)
    WHERE regexp_replace(t, '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g') <> ''
    """,
)
def clean_text(spark, folder):
    docs = table(spark, folder, "documents")
    padded = F.when(F.col("source") == "src3", "\u00a0 \n").otherwise(
        F.concat(F.lit("\u00a0\t"), "text", F.lit(" \u2003"))
    )
    return text.clean_text(docs.select("doc_id", padded.alias("text")))


@query(
    "cleaning_counts",
    rf"""
    SELECT count(*) FILTER (coalesce(t, '') <> '') AS kept, count(*) FILTER (coalesce(t, '') = '') AS skipped
    FROM (SELECT regexp_replace(CASE WHEN source = 'src3' THEN NULL WHEN source = 'src4' THEN ' ' ELSE text END,
                                '^{BLANK_SQL}+|{BLANK_SQL}+$', '', 'g') AS t FROM documents)
    """,
)
def cleaning_counts(spark, folder):
    docs = table(spark, folder, "documents")
    holed = F.when(F.col("source") == "src4", " ").when(F.col("source") != "src3", F.col("text"))
    return text.cleaning_counts(docs.select(holed.alias("text")))


def _chunk_sql(n: int) -> str:
    return f"""
    WITH RECURSIVE c(doc_id, chunk_no, text, rest) AS (
        SELECT doc_id, -1, '', text FROM (SELECT doc_id, trim(text, E' \\t\\n\\r') AS text FROM documents)
        UNION ALL
        SELECT doc_id, chunk_no + 1,
               CASE WHEN length(rest) <= {n} THEN rest WHEN cut = 0 THEN substr(rest, 1, {n})
                    ELSE substr(rest, 1, cut - 1) END,
               CASE WHEN length(rest) <= {n} THEN '' WHEN cut = 0 THEN ltrim(substr(rest, {n} + 1), ' ')
                    ELSE ltrim(substr(rest, cut), ' ') END
        FROM (SELECT doc_id, chunk_no, rest,
                     CASE WHEN strpos(substr(rest, 1, {n}), ' ') = 0 THEN 0
                          ELSE {n} + 1 - strpos(reverse(substr(rest, 1, {n})), ' ') END AS cut
              FROM c WHERE rest <> ''))
    SELECT doc_id, chunk_no, text FROM c WHERE chunk_no >= 0
    """


def _chunks(spark, folder, n):
    docs = table(spark, folder, "documents").select("doc_id", text.strip("text").alias("text"))
    return text.chunk_text(docs, max_chars=n)


@query("chunk_text", _chunk_sql(300))
def chunk_text(spark, folder):
    return _chunks(spark, folder, 300)


@query("chunk_text_8000", _chunk_sql(8000))
def chunk_text_8000(spark, folder):
    return _chunks(spark, folder, 8000)


@query(
    "text_sizes",
    """
    SELECT doc_id, length(text) AS chars, strlen(text)::BIGINT AS bytes,
           (strlen(text) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS line_bytes
    FROM documents
    """,
)
def text_sizes(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.length("text").cast("bigint").alias("chars"),
        text.utf8_bytes("text").alias("bytes"),
        text.utf8_bytes("text", True).alias("line_bytes"),
    )


@query(
    "ensure_newline",
    """
    SELECT doc_id, CASE WHEN t LIKE '%' || chr(10) THEN t ELSE t || chr(10) END AS text
    FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN text || chr(10) ELSE text END AS t FROM documents)
    """,
)
def ensure_newline(spark, folder):
    docs = table(spark, folder, "documents")
    ended = F.when(F.col("lang") == "fr", F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", text.ensure_newline(ended).alias("text"))


@query(
    "parse_lang_code",
    """
    SELECT doc_id, lang AS iso,
           CASE lang WHEN 'fr' THEN NULL WHEN 'de' THEN 'Latn_' || source ELSE source END AS script
    FROM documents
    """,
)
def parse_lang_code(spark, folder):
    docs = table(spark, folder, "documents")
    code = (
        F.when(F.col("lang") == "fr", F.col("lang"))
        .when(F.col("lang") == "de", F.concat_ws("_", "lang", F.lit("Latn"), "source"))
        .otherwise(F.concat_ws("_", "lang", "source"))
    )
    iso, script = text.lang_code_parts(code)
    return docs.select("doc_id", iso.alias("iso"), script.alias("script"))


@query(
    "filter_skip_limit",
    "SELECT doc_id, source FROM documents WHERE source LIKE '%src1%' ORDER BY doc_id LIMIT 40 OFFSET 15",
)
def filter_skip_limit(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return docs.filter(F.col("source").contains("src1")).orderBy("doc_id").offset(15).limit(40)


@query(
    "path_parts",
    """
    SELECT doc_id, source || '.parquet' AS base, source AS stem FROM documents
    """,
)
def path_parts(spark, folder):
    path = F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit(".parquet"))
    return table(spark, folder, "documents").select(
        "doc_id", text.basename(path).alias("base"), text.stem(path).alias("stem")
    )


@query(
    "word_counts",
    r"""
    SELECT word, count(*) AS freq
    FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS word FROM documents) GROUP BY word
    """,
)
def words(spark, folder):
    return word_counts(table(spark, folder, "documents"), preset="words")


@query(
    "pretok_whitespace",
    f"""
    SELECT lang, word, count(*) AS freq
    FROM (SELECT lang, unnest(regexp_extract_all(text, '{WORD_OR_MARKS}')) AS word FROM documents)
    GROUP BY lang, word
    """,
)
def pretok_whitespace(spark, folder):
    return word_counts(table(spark, folder, "documents"), preset="whitespace", by=("lang",))


@query(
    "pretok_gpt2",
    f"""
    SELECT word, count(*) AS freq
    FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'),
                        '{GPT2_COLLAPSED.replace("'", "''")}')) AS word FROM documents)
    GROUP BY word
    """,
)
def pretok_gpt2(spark, folder):
    docs = table(spark, folder, "documents")
    collapsed = docs.select(F.regexp_replace("text", r"(?U)\s+", " ").alias("text"))
    return word_counts(collapsed, preset="gpt2")


def _lossless(spark, folder, preset):
    docs = table(spark, folder, "documents")
    pieces = pretok.pretokens("text", preset)
    return docs.select(
        "doc_id",
        F.array_join(pieces, "").alias("text"),
        (F.size(pieces) > 0).alias("has_pieces"),
    )


for _preset in ("byte_level", "gpt4", "gpt4-contractions", "apertus", "superbpe-phase2", "apertus-phase2"):
    # The pieces of every text joined again give the text.
    query(
        f"pretok_{_preset.replace('-', '_')}_lossless",
        "SELECT doc_id, text, true AS has_pieces FROM documents",
    )(lambda spark, folder, preset=_preset: _lossless(spark, folder, preset))


@query(
    "byte_symbols",
    "SELECT doc_id, regexp_replace(hex(encode(text)), '(..)', '<\\1>', 'g') AS symbols FROM documents",
)
def byte_symbols(spark, folder):
    return table(spark, folder, "documents").select("doc_id", pretok.byte_symbols("text").alias("symbols"))


@query(
    "char_coverage",
    """
    WITH c AS (SELECT ch, count(*) AS n
               FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
               WHERE NOT regexp_matches(ch, '^\\s*$') GROUP BY ch),
         s AS (SELECT hex(encode(ch)) AS code, n, sum(n) OVER (ORDER BY n DESC, hex(encode(ch))
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before, sum(n) OVER () AS total FROM c)
    SELECT code, n, before < 0.99 * total AS kept FROM s
    """,
)
def char_coverage(spark, folder):
    return pretok.char_coverage(table(spark, folder, "documents"), coverage=0.99)


@query(
    "bpe_pair_counts",
    r"""
    WITH w AS (SELECT word, count(*) AS f
               FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS word FROM documents) GROUP BY word),
         p AS (SELECT regexp_extract_all(hex(encode(word)), '..') AS s, f FROM w)
    SELECT s[i] AS "left", s[i + 1] AS "right", sum(f)::BIGINT AS n
    FROM (SELECT s, f, unnest(range(1, len(s))) AS i FROM p) GROUP BY ALL
    """,
)
def bpe_pair_counts(spark, folder):
    return pair_counts(symbol_table(table(spark, folder, "documents"), preset="words"))


@query(
    "topk_vocab",
    r"""
    SELECT token, n FROM (
        SELECT word AS token, count(*) AS n
        FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS word FROM documents) GROUP BY word)
    ORDER BY n DESC, hex(encode(token)) LIMIT 500
    """,
)
def topk_vocab(spark, folder):
    from lingua_spark.learn.phrases import top_tokens

    counts = word_counts(table(spark, folder, "documents"), preset="words")
    return top_tokens(counts.select(F.col("word").alias("token"), F.col("freq").alias("n")), 500)
