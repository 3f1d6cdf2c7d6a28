"""Tokenizer learning and encoding.

The DuckDB counterparts make one merge per step in a chain of CTEs. They check
the learners' result, including the rule by which these make several merges
per round.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS, symbol_text
from lingua_spark.learn import bpe, context, parity, phrases, unigram
from lingua_spark.learn.api import fit
from lingua_spark.learn.model import read_tokenizer
from lingua_spark.learn.wordtable import word_counts
from lingua_spark.queries.registry import query, table
from lingua_spark.queries.texts import WORD_OR_MARKS
from lingua_spark.runtime import scratch_path, stage, subfolders
from lingua_spark.sources.scans import load_merges
from lingua_spark.sources.sinks import write_tokenizer
from lingua_spark.streaming import ingest

WORDS = r"regexp_extract_all(text, '\S+')"
TOKENS = f"regexp_extract_all(text, '{WORD_OR_MARKS}')"
BYTES = "regexp_replace(hex(encode({0})), '(..)', '<\\1>', 'g')"
CHARS = "'<' || array_to_string(list_transform(string_split({0}, ''), lambda c: hex(encode(c))), '><') || '>'"
PAIRS = (
    "SELECT {keys} p[i] AS l, p[i + 1] AS r, sum(f) AS n "
    "FROM (SELECT {keys} p, f, unnest(range(1, len(p))) AS i "
    "FROM (SELECT {keys} string_split(s[2:-2], '><') AS p, f FROM {words})) GROUP BY ALL"
)


def words_cte(pieces: str = WORDS, symbols: str = BYTES) -> str:
    return (
        f"w0 AS MATERIALIZED (SELECT word, {symbols.format('word')} AS s, count(*) AS f "
        f"FROM (SELECT unnest({pieces}) AS word FROM documents) GROUP BY word)"
    )


def texts_cte(name: str, lang: str = "") -> str:
    return f"{name} AS MATERIALIZED (SELECT {lang} text AS word, {BYTES.format('text')} AS s, 1 AS f FROM documents)"


def merge_steps(first: int, last: int, condition: str = "n >= 2") -> str:
    """CTEs m1..: the best pair of the words before, then the words after."""
    steps = []
    for k in range(first, last):
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT l, r, n FROM ({PAIRS.format(keys='', words=f'w{k}')}) "
            f"WHERE {condition} ORDER BY n DESC, l, r LIMIT 1)"
        )
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT word, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s, f "
            f"FROM w{k}, m{k})"
        )
    return ", ".join(steps)


def merges_select(n: int) -> str:
    return " UNION ALL ".join(
        f'SELECT {k}::INTEGER AS rank, l AS "left", r AS "right", n::BIGINT AS n FROM m{k}' for k in range(n)
    )


def _documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "text")


N_MERGES = 32


@query("learn_bpe", f"WITH {words_cte()}, {merge_steps(0, N_MERGES)} {merges_select(N_MERGES)}")
def learn_bpe(spark, folder):
    return bpe.learn_bpe(_documents(spark, folder), n_merges=N_MERGES, preset="words").merges_table()


@query("learn_bpe_char", f"WITH {words_cte(symbols=CHARS)}, {merge_steps(0, 16)} {merges_select(16)}")
def learn_bpe_char(spark, folder):
    model = bpe.learn_bpe(_documents(spark, folder), n_merges=16, preset="words", unit="char")
    return model.merges_table()


@query(
    "learn_bpe_maxlen",
    f"WITH {words_cte()}, {merge_steps(0, 16, 'n >= 2 AND length(l) + length(r) <= 6')} {merges_select(16)}",
)
def learn_bpe_maxlen(spark, folder):
    return bpe.learn_bpe(_documents(spark, folder), n_merges=16, preset="words", max_type_length=3).merges_table()


@query("learn_bpe_byte_level")
def learn_bpe_byte_level(spark, folder):
    """The default preset, to a vocabulary size; ids of all tokens."""
    model = bpe.learn_bpe(_documents(spark, folder), vocab_size=130)
    return model.vocab_table().select("token", "id")


@query("learn_picky_bpe")
def learn_picky_bpe(spark, folder):
    model = bpe.learn_picky_bpe(_documents(spark, folder), n_events=24, preset="words", threshold=0.5)
    return model.events_table()


_SCAFFOLD = 20


@query(
    "learn_scaffold_bpe",
    f"""
    WITH {words_cte()}, {merge_steps(0, _SCAFFOLD + 1, 'n >= 2 AND length(l) + length(r) <= 32')},
         c AS (SELECT token, sum(f) AS k FROM (
                   SELECT unnest(string_split(s[2:-2], '><')) AS token, f FROM w{_SCAFFOLD}) GROUP BY token),
         m AS ({merges_select(_SCAFFOLD)})
    SELECT m.rank, m."left", m."right", m.n, coalesce(c.k, 0) < (SELECT n FROM m{_SCAFFOLD}) AS scaffold
    FROM m LEFT JOIN c ON c.token = m."left" || m."right"
    """,
)
def learn_scaffold_bpe(spark, folder):
    model = bpe.learn_scaffold_bpe(_documents(spark, folder), n_merges=_SCAFFOLD, preset="words")
    hidden = F.col("token").isin(list(model.hidden))
    merged = model.merges_table().withColumn("token", F.concat("left", "right"))
    return merged.withColumn("scaffold", hidden).drop("token")


_TRIM = 16
_TRIM_BELOW = 4000


@query(
    "learn_trimmed_bpe",
    f"""
    WITH {words_cte()}, {merge_steps(0, _TRIM)},
         t AS (SELECT unnest(string_split(s[2:-2], '><')) AS token, f FROM w{_TRIM}),
         c AS (SELECT token, sum(f) AS n FROM t GROUP BY token),
         m AS ({merges_select(_TRIM)})
    SELECT rank, "left", "right", coalesce(c.n, 0) < {_TRIM_BELOW} * (SELECT count(*) FROM documents) / 1000 AS trimmed
    FROM m LEFT JOIN c ON c.token = m."left" || m."right"
    """,
)
def learn_trimmed_bpe(spark, folder):
    docs = _documents(spark, folder)
    below = _TRIM_BELOW * docs.count() / 1000
    model = bpe.learn_trimmed_bpe(docs, n_merges=_TRIM, min_count=below, preset="words")
    merged = model.merges_table()
    return merged.select("rank", "left", "right", F.concat("left", "right").isin(list(model.hidden)).alias("trimmed"))


_SUPER, _SUPER_FIRST = 16, 10


@query(
    "learn_superbpe",
    f"""
    WITH {words_cte()}, {merge_steps(0, _SUPER_FIRST)}, {texts_cte("v0")},
         {", ".join(
             f"v{k + 1} AS MATERIALIZED (SELECT word, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s, f FROM v{k}, m{k})"
             for k in range(_SUPER_FIRST))},
         {merge_steps(_SUPER_FIRST, _SUPER).replace(f"FROM w{_SUPER_FIRST})", f"FROM v{_SUPER_FIRST})").replace(f"FROM w{_SUPER_FIRST},", f"FROM v{_SUPER_FIRST},")}
    {merges_select(_SUPER)}
    """,
)
def learn_superbpe(spark, folder):
    model = bpe.learn_super_bpe(
        _documents(spark, folder), n_merges=_SUPER, phase1_merges=_SUPER_FIRST, preset="words", preset_phase2="text"
    )
    return model.merges_table()


_HALF = """
    half AS MATERIALIZED (SELECT * FROM (
        SELECT *, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS upto, sum(octet_length(encode(text))) OVER () AS total
        FROM documents) WHERE upto <= total // 2)"""


@query(
    "learn_superbpe_given",
    f"""
    WITH {words_cte()}, {merge_steps(0, _SUPER_FIRST)}, {_HALF}, {texts_cte("v0").replace("FROM documents", "FROM half")},
         {", ".join(
             f"v{k + 1} AS MATERIALIZED (SELECT word, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s, f FROM v{k}, m{k})"
             for k in range(_SUPER_FIRST))},
         {merge_steps(_SUPER_FIRST, _SUPER).replace(f"FROM w{_SUPER_FIRST})", f"FROM v{_SUPER_FIRST})").replace(f"FROM w{_SUPER_FIRST},", f"FROM v{_SUPER_FIRST},")}
    SELECT rank, "left", "right", CASE WHEN rank < {_SUPER_FIRST} THEN 0 ELSE n END::BIGINT AS n FROM ({merges_select(_SUPER)})
    """,
)
def learn_superbpe_given(spark, folder):
    """The second phase on the first half of the bytes, from a file of merges."""
    docs = _documents(spark, folder)
    path = scratch_path(spark, "merges")
    learned = bpe.learn_bpe(docs, n_merges=_SUPER_FIRST, preset="words").merges_table()
    learned.orderBy("rank").select(F.concat_ws(" ", "left", "right").alias("value")).coalesce(1).write.text(path)
    merges = [(r["left"], r["right"]) for r in load_merges(spark, path).orderBy("rank").collect()]
    size = docs.agg(F.sum(F.octet_length(F.encode("text", "UTF-8")))).first()[0]
    model = bpe.learn_super_bpe(
        docs, n_merges=_SUPER, phase1_merges=_SUPER_FIRST, preset_phase2="text", merges=merges, num_bytes=size // 2
    )
    return model.merges_table()


@query("learn_superbpe_regex")
def learn_superbpe_regex(spark, folder):
    """The published presets of both phases."""
    return bpe.learn_super_bpe(_documents(spark, folder), n_merges=12).merges_table()


def parity_steps(first: int, last: int, train: str, dev: str) -> str:
    """Per step: the worst compressed language of the development texts, its
    best pair, and both tables after the merge."""
    steps = []
    for k in range(first, last):
        a, b = (train, dev) if k == first else (f"w{k}", f"d{k}")
        steps.append(
            f"g{k} AS MATERIALIZED (SELECT lang FROM (SELECT lang, sum(f * (length(s) - length(replace(s, '<', '')))) AS c "
            f"FROM {b} GROUP BY lang) JOIN units USING (lang) ORDER BY units / c::DOUBLE, first LIMIT 1)"
        )
        steps.append(
            f"m{k} AS MATERIALIZED (SELECT l, r, n FROM ({PAIRS.format(keys='lang,', words=a)}) "
            f"WHERE n >= 2 AND lang = (SELECT lang FROM g{k}) ORDER BY n DESC, l, r LIMIT 1)"
        )
        for name, source in (("w", a), ("d", b)):
            steps.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT lang, "
                f"replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s, f FROM {source}, m{k})"
            )
    return ", ".join(steps)


def _parity_words(name: str, where: str = "true") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT lang, {BYTES.format('word')} AS s, count(*) AS f "
        f"FROM (SELECT lang, unnest({TOKENS}) AS word FROM documents WHERE {where}) GROUP BY lang, word)"
    )


# Texts are stripped before they are measured.
_UNITS = (
    "units AS MATERIALIZED (SELECT lang, sum(strlen(trim(text, E' \\t\\n\\r'))) AS units, "
    "first(f) AS first FROM (SELECT *, min(doc_id) OVER (PARTITION BY lang) AS f FROM documents) GROUP BY lang)"
)
_PARITY = 14


@query(
    "learn_parity_bpe",
    f"WITH {_UNITS}, {_parity_words('t0')}, {parity_steps(0, _PARITY, 't0', 't0')} {merges_select(_PARITY)}",
)
def learn_parity_bpe(spark, folder):
    docs = _documents(spark, folder)
    return parity.learn_parity_bpe(docs, _PARITY, dev=docs, unit="byte").merges_table()


_RATIO = {"en": 1.5, "de": 1.8, "fr": 1.2, "es": 1.6}


@query(
    "learn_parity_bpe_ratio",
    f"""
    WITH {_parity_words('t0')},
         units AS MATERIALIZED (
             SELECT lang, sum(f * (length(s) - length(replace(s, '<', ''))))
                    / (CASE lang {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _RATIO.items())} END)::DOUBLE AS units,
                    first(o.first) AS first
             FROM t0 JOIN (SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang) o USING (lang) GROUP BY lang),
         {parity_steps(0, 12, 't0', 't0')} {merges_select(12)}
    """,
)
def learn_parity_bpe_ratio(spark, folder):
    return parity.learn_parity_bpe(_documents(spark, folder), 12, ratio=_RATIO).merges_table()


_PSUPER, _PSUPER_FIRST = 10, 7


def _replay(name: str, n: int) -> str:
    return ", ".join(
        f"{name}{k + 1} AS MATERIALIZED (SELECT lang, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s, f "
        f"FROM {name}{k}, m{k})"
        for k in range(n)
    )


@query(
    "learn_parity_superbpe",
    f"""
    WITH {_UNITS}, {_parity_words('t0')}, {parity_steps(0, _PSUPER_FIRST, 't0', 't0')},
         x0 AS MATERIALIZED (SELECT lang, {BYTES.format("trim(text, E' \\t\\n\\r')")} AS s, 1 AS f FROM documents),
         {_replay("x", _PSUPER_FIRST)},
         {parity_steps(_PSUPER_FIRST, _PSUPER, f"x{_PSUPER_FIRST}", f"x{_PSUPER_FIRST}").replace(
             f"w{_PSUPER_FIRST + 1} AS", f"y{_PSUPER_FIRST + 1} AS").replace(f"w{_PSUPER_FIRST + 1})", f"y{_PSUPER_FIRST + 1})")
             .replace(f"FROM w{_PSUPER_FIRST + 1}", f"FROM y{_PSUPER_FIRST + 1}")}
    {merges_select(_PSUPER)}
    """,
)
def learn_parity_superbpe(spark, folder):
    docs = _documents(spark, folder)
    model = parity.learn_parity_super_bpe(docs, _PSUPER, phase1_merges=_PSUPER_FIRST, dev=docs, unit="byte")
    return model.merges_table()


@query(
    "unigram_seed",
    f"""
    WITH w AS (SELECT word, count(*) AS f FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word),
         b AS (SELECT word, f, unnest(range(1, length(word) + 1)) AS i FROM w),
         p AS (SELECT substr(word, i, k) AS piece, f
               FROM (SELECT word, f, i, unnest(range(1, least(8, length(word) - i + 1) + 1)) AS k FROM b)),
         c AS (SELECT piece, sum(f)::BIGINT AS n, (sum(f) * length(piece))::BIGINT AS score FROM p GROUP BY piece)
    SELECT * FROM c WHERE length(piece) = 1 UNION ALL
    (SELECT * FROM c WHERE length(piece) > 1 AND n >= 2 ORDER BY score DESC, hex(encode(piece)) LIMIT 2000)
    """,
)
def unigram_seed(spark, folder):
    words = word_counts(_documents(spark, folder), preset="words")
    return unigram.seed_pieces(words, 2000, 8)


@query("learn_unigram")
def learn_unigram(spark, folder):
    return _unigram(spark, folder).vocab_table()


def _unigram(spark, folder):
    """The published vocabulary size, from a million seeds of up to 16 letters."""
    return unigram.learn_unigram(_documents(spark, folder), 128_000)


@query("encode_unigram")
def encode_unigram(spark, folder):
    encoded = _unigram(spark, folder).encode(_documents(spark, folder), out="tokens", as_tokens=True)
    return encoded.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


_COVERAGE = 0.99


@query(
    "unigram_fallback",
    f"""
    WITH w AS (SELECT doc_id, lang, unnest({WORDS}) AS word FROM documents),
         c AS (SELECT doc_id, lang, unnest(string_split(word, '')) AS ch FROM w),
         n AS (SELECT ch, count(*) AS n FROM c GROUP BY ch),
         kept AS (SELECT ch FROM (SELECT ch, n, sum(n) OVER () AS total,
                         coalesce(sum(n) OVER (ORDER BY n DESC, hex(encode(ch)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                  FROM n) WHERE before < {_COVERAGE}::DOUBLE * total)
    SELECT lang, '<0x' || hex[i:i + 1] || '>' AS token, count(*) AS n
    FROM (SELECT lang, hex(encode(ch)) AS hex, unnest(range(1, length(hex(encode(ch))), 2)) AS i
          FROM c WHERE ch NOT IN (SELECT ch FROM kept))
    GROUP BY ALL
    """,
)
def unigram_fallback(spark, folder):
    """Bytes that spell the characters below the coverage, by language."""
    docs = _documents(spark, folder)
    model = unigram.learn_unigram(
        docs, 550, initial_vocab_size=600, max_piece_length=8, character_coverage=_COVERAGE
    )
    tokens = model.encode(docs.select("lang", "text"), out="tokens", as_tokens=True)
    spelled = F.filter("tokens", lambda token: token.rlike("^<0x..>$"))
    rows = tokens.select("lang", F.explode(spelled).alias("token"))
    return rows.groupBy("lang", "token").agg(F.count("*").alias("n"))


@query(
    "ngram_vocab",
    f"""
    WITH w AS (SELECT word, count(*) AS f FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word)
    SELECT token, sum(f)::BIGINT AS n
    FROM (SELECT substr(word, i, 3) AS token, f
          FROM (SELECT word, f, unnest(range(1, length(word) - 1)) AS i FROM w WHERE length(word) >= 3))
    GROUP BY token
    """,
)
def ngram_vocab(spark, folder):
    return phrases.ngram_vocab(_documents(spark, folder))


@query("lzw_vocab")
def lzw_vocab(spark, folder):
    return phrases.lzw_vocab(_documents(spark, folder), 500)


@query("sage_prune")
def sage_prune(spark, folder):
    docs = _documents(spark, folder)
    model = bpe.learn_bpe(docs, n_merges=12, preset="words")
    return context.sage_prune(model, docs, model.vocab_size - 4).withColumn("text", symbol_text("token"))


_ENCODE = 12


_COUNTS_SQL = f"""
    WITH {words_cte()}, {merge_steps(0, _ENCODE)},
         z AS (SELECT word, length(s) - length(replace(s, '<', '')) AS n FROM w{_ENCODE})
    SELECT doc_id, coalesce(sum(n), 0)::BIGINT AS n_tokens
    FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) JOIN z USING (word) GROUP BY doc_id
"""


@query("tokenizer_roundtrip", _COUNTS_SQL)
def tokenizer_roundtrip(spark, folder):
    """Learn, write, read in a second job, encode."""
    docs = _documents(spark, folder)
    path = scratch_path(spark, "tokenizer")
    write_tokenizer(bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words"), path)
    encoded = read_tokenizer(spark, path).encode(docs)
    return encoded.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"))


@query(
    "encode_null_texts",
    f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_tokens END AS n_tokens FROM ({_COUNTS_SQL})",
)
def encode_null_texts(spark, folder):
    """A null text has no tokens, in plain and in stochastic encoding."""
    docs = _documents(spark, folder)
    model = bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words")
    holed = docs.withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    plain = model.encode(holed).withColumn("n", F.size("input_ids"))
    both = model.encode_dropout(plain, 0.0, out="again")
    return both.filter(F.size("again") == F.col("n")).select("doc_id", F.col("n").cast("bigint").alias("n_tokens"))


@query(
    "stream_encoded",
    f"""
    WITH {words_cte()}, {merge_steps(0, _ENCODE)},
         p AS (SELECT doc_id, lang, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS place FROM documents),
         t AS (SELECT doc_id, lang, string_split(string_agg(s, '' ORDER BY place)[2:-2], '><') AS w
               FROM p JOIN w{_ENCODE} USING (word) GROUP BY doc_id, lang)
    SELECT lang, doc_id, i::INTEGER AS chunk_no, array_to_string(w[i * 64 + 1 : i * 64 + 64], ' ') AS tokens
    FROM (SELECT lang, doc_id, w, unnest(range(0, len(w) // 64)) AS i FROM t)
    """,
)
def stream_encoded(spark, folder):
    """A folder per language as one stream, encoded by a learned tokenizer."""
    docs = _documents(spark, folder)
    model = bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words")
    source, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    docs.select("doc_id", "text", "lang").repartition(4).write.partitionBy("lang").parquet(source)
    folders = {f.rpartition("=")[2]: f for f in subfolders(spark, source)}
    rows = ingest.read_folders(spark, folders, "doc_id bigint, text string", 2, "lang")
    chunks = ingest.encoded_stream(rows, model, ("lang", "doc_id"), 64, as_tokens=True)
    ingest.write_stream(chunks, sink, scratch_path(spark, "stream-log")).awaitTermination()
    written = spark.read.schema(chunks.schema).parquet(sink)
    return written.select("lang", "doc_id", "chunk_no", F.array_join("input_ids", " ").alias("tokens"))


@query("encode_counts", _COUNTS_SQL)
def encode_counts(spark, folder):
    docs = _documents(spark, folder)
    model = bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words")
    encoded = model.encode(docs)
    return encoded.select("doc_id", F.size("input_ids").cast("bigint").alias("n_tokens"))


@query(
    "encode_bpe_fertility",
    f"""
    WITH {words_cte()}, {merge_steps(0, _ENCODE)},
         z AS (SELECT word, length(s) - length(replace(s, '<', '')) AS n FROM w{_ENCODE}),
         d AS (SELECT lang, unnest({WORDS}) AS word FROM documents)
    SELECT coalesce(lang, 'TOTAL') AS lang, sum(n)::BIGINT AS tokens, count(*) AS words,
           round(sum(n) / count(*)::DOUBLE, 6) AS fertility
    FROM d JOIN z USING (word) GROUP BY ROLLUP (lang)
    """,
)
def encode_bpe_fertility(spark, folder):
    """Fertility of a learned tokenizer from counts of distinct words."""
    docs = _documents(spark, folder)
    counts = stage(word_counts(docs, preset="words", by=("lang",)), "word_counts")
    model = bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words", counts=counts)
    words = model.segment_words(counts)
    sums = words.rollup("lang").agg(
        F.sum(F.size("tokens") * F.col("freq")).alias("tokens"), F.sum("freq").alias("words")
    )
    return sums.select(
        F.coalesce("lang", F.lit("TOTAL")).alias("lang"),
        "tokens",
        "words",
        F.round(F.col("tokens") / F.col("words"), 6).alias("fertility"),
    )


@query("encode_dropout")
def encode_dropout(spark, folder):
    docs = _documents(spark, folder)
    model = bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words", max_type_length=16)
    encoded = model.encode_dropout(docs, 0.1)
    return encoded.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


_TOKENS_SQL = f"""
    WITH {words_cte()}, {merge_steps(0, _ENCODE)},
         p AS (SELECT doc_id, lang, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS place FROM documents),
         t AS (SELECT doc_id, lang, string_split(string_agg(s, '' ORDER BY place)[2:-2], '><') AS tokens
               FROM p JOIN w{_ENCODE} USING (word) GROUP BY doc_id, lang)
"""


@query(
    "encode_dropout_zero",
    f"{_TOKENS_SQL} SELECT doc_id, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM documents LEFT JOIN t USING (doc_id)",
)
def encode_dropout_zero(spark, folder):
    """The stochastic encoder without dropout gives the plain segmentation."""
    docs = _documents(spark, folder)
    encoded = fit(docs, "bpe-dropout", None, n_merges=_ENCODE, preset="words").encode_dropout(docs, 0.0)
    return encoded.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def vocab_cte(n: int) -> str:
    """v: the ids of special tokens, bytes in order and then ``n`` merges."""
    special = ", ".join(f"('{t}', {i}::INTEGER)" for i, t in enumerate(SPECIAL_TOKENS))
    return f"""
        base AS (SELECT DISTINCT unnest(string_split(s[2:-2], '><')) AS token FROM w0),
        v AS (SELECT * FROM (VALUES {special}) AS special(token, id)
              UNION ALL SELECT token, ({len(SPECIAL_TOKENS) - 1} + row_number() OVER (ORDER BY token))::INTEGER FROM base
              UNION ALL SELECT "left" || "right", ({len(SPECIAL_TOKENS)} + (SELECT count(*) FROM base) + rank)::INTEGER
              FROM ({merges_select(n)}))"""


@query(
    "fit_vocab",
    f"WITH {words_cte()}, {merge_steps(0, 16, 'n >= 2 AND length(l) + length(r) <= 6')}, {vocab_cte(16)} SELECT token, id FROM v",
)
def fit_vocab(spark, folder):
    """A learner by its name; ids of the whole vocabulary."""
    model = fit(_documents(spark, folder), "classic-bpe", None, n_merges=16, preset="words", max_type_length=3)
    return model.vocab_table().select("token", "id")


@query(
    "training_sequences_words",
    f"""
    {_TOKENS_SQL}, {vocab_cte(_ENCODE)},
         o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place,
                      count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang) AS idx,
                      (SELECT count(DISTINCT lang) FROM documents) AS k FROM documents),
         q AS (SELECT doc_id, lang, (place - 1) * k + idx AS position, (n - 1) * k + idx AS last FROM o),
         r AS (SELECT doc_id, lang, CASE WHEN position <= 100 THEN 'eval' ELSE 'train' END AS part FROM q
               WHERE position <= (SELECT min(last) FROM q)),
         u AS (SELECT doc_id, lang, part, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS i
               FROM r JOIN t USING (doc_id, lang))
    SELECT lang, doc_id, part, (i // 256)::INTEGER AS chunk_no, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids
    FROM u JOIN v USING (token) GROUP BY lang, doc_id, part, i // 256 HAVING count(*) = 256
    """,
)
def training_sequences_words(spark, folder):
    """As training_sequences, over pre-tokens that DuckDB has."""
    from lingua_spark.plans.training_sequences import training_sequences as sequences

    docs = _documents(spark, folder)
    model = bpe.learn_bpe(docs, n_merges=_ENCODE, preset="words")
    chunks = sequences(docs, model, max_length=256, eval_docs=100, source="lang")
    return chunks.select("lang", "doc_id", "part", "chunk_no", F.array_join("input_ids", " ").alias("ids"))


@query("training_sequences")
def training_sequences(spark, folder):
    """Mixed sources, held-out documents and packed chunks of learned ids."""
    from lingua_spark.plans.training_sequences import training_sequences as sequences

    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    model = bpe.learn_bpe(docs, n_merges=8, preset="byte_level")
    chunks = sequences(docs, model, max_length=256, eval_docs=100, source="lang")
    return chunks.select("doc_id", "part", "chunk_no", F.array_join("input_ids", " ").alias("ids"))
