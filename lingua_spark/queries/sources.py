"""Scans, sinks and the language table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingua_spark.functions.text import utf8_bytes
from lingua_spark.operators.corpus import modulo_dev_split
from lingua_spark.queries.registry import query, table, values
from lingua_spark.runtime import scratch_path, stage
from lingua_spark.sources import languages, scans, sinks

LANGUAGE_SQL = (
    f"(VALUES {values(languages.LANGUAGES)}) "
    "AS m(lang, flores_code, cc100_code, cc100_est_gb, fineweb_code, fineweb_est_gb)"
)
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@query("scan_jsonl_roundtrip", "SELECT doc_id, lang AS language, text FROM documents WHERE text <> ''")
def scan_jsonl_roundtrip(spark, folder):
    path = scratch_path(spark, "jsonl")
    docs = table(spark, folder, "documents")
    docs.select("doc_id", F.col("lang").alias("language"), "text").write.json(path)
    return scans.scan_jsonl(spark, path, extra="doc_id bigint").select("doc_id", "language", "text")


@query(
    "scan_text_tree",
    """
    SELECT lang AS language, count(*) AS lines, sum(length(line))::BIGINT AS chars
    FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE line <> '' GROUP BY lang
    """,
)
def scan_text_tree(spark, folder):
    path = scratch_path(spark, "tree")
    docs = table(spark, folder, "documents")
    sinks.write_text(docs.select("lang", F.lit("train").alias("split"), "text"), path)
    lines = scans.scan_text_tree(spark, path, "train")
    return lines.groupBy("language").agg(
        F.count("*").alias("lines"), F.sum(F.length("text")).cast("bigint").alias("chars")
    )


@query(
    "scan_parquet_stem",
    "SELECT doc_id, 'documents' AS language, doc_id AS row_index, length(text) AS chars FROM documents",
)
def scan_parquet_stem(spark, folder):
    docs = scans.scan_parquet_files(spark, folder, "documents.parquet")
    return docs.select("doc_id", "language", "row_index", F.length("text").cast("bigint").alias("chars"))


@query(
    "scan_multi_source",
    """
    SELECT doc_id, text, lang AS source,
           (dense_rank() OVER (ORDER BY lang) - 1)::INTEGER AS source_idx
    FROM documents
    """,
)
def scan_multi_source(spark, folder):
    path = scratch_path(spark, "folders")
    docs = table(spark, folder, "documents")
    # One folder per language, every second one with the text under another name.
    for i, row in enumerate(docs.select("lang").distinct().orderBy("lang").collect()):
        name = "content" if i % 2 else "text"
        part = docs.filter(F.col("lang") == row["lang"])
        part.select("doc_id", F.col("text").alias(name), "n_chars").write.parquet(f"{path}/{row['lang']}")
    return scans.scan_parquet_folders(spark, path, keep=("doc_id",))


_COLUMNS_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS file, (SELECT count(*) FROM {t}) AS rows, "
    f"(SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() "
    f"WHERE table_name = '{t}') AS columns"
    for t in TABLES
)


@query(
    "inspect_sources",
    f"WITH f AS ({_COLUMNS_SQL}) SELECT file, rows, columns FROM f "
    "UNION ALL SELECT 'TOTAL', sum(rows)::BIGINT, '' FROM f",
)
def inspect_sources(spark, folder):
    return scans.inspect_sources([table(spark, folder, t) for t in TABLES])


@query(
    "load_results",
    """
    SELECT l_returnflag || l_linenumber AS model_path, l_returnflag AS model_size,
           CASE WHEN l_linenumber <> 7 THEN l_linenumber::BIGINT END AS seed,
           round(avg(l_extendedprice), 6) AS bits_per_byte, count(*) AS num_examples
    FROM lineitem GROUP BY l_returnflag, l_linenumber
    """,
)
def load_results(spark, folder):
    path = scratch_path(spark, "results")
    runs = (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", "l_linenumber")
        .agg(F.round(F.avg("l_extendedprice"), 6).alias("bits_per_byte"), F.count("*").alias("num_examples"))
        .select(
            F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("model_path"),
            F.col("l_returnflag").alias("model_size"),
            # A null key is absent from the file: the frame is a union of keys.
            F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("bigint")).alias("seed"),
            "bits_per_byte",
            "num_examples",
        )
    )
    runs.withColumn("run", F.col("model_path")).repartition("run").write.partitionBy("run").json(path)
    columns = ["model_path", "model_size", "seed", "bits_per_byte", "num_examples"]
    return scans.load_results(spark, path).select(*columns)


_WORD_PAIRS_SQL = """
    SELECT prev, cur, count(*) AS n
    FROM (SELECT w[i] AS prev, w[i + 1] AS cur
          FROM (SELECT w, unnest(range(1, len(w))) AS i
                FROM (SELECT regexp_extract_all(text, '\\S+') AS w FROM documents)))
    GROUP BY prev, cur
"""


@query(
    "load_merges",
    f"""
    SELECT (row_number() OVER (ORDER BY n DESC, prev, cur) - 1)::INTEGER AS rank, prev AS "left", cur AS "right"
    FROM ({_WORD_PAIRS_SQL}) QUALIFY rank < 120
    """,
)
def load_merges(spark, folder):
    from lingua_spark.functions.text import words
    from lingua_spark.operators.metrics import token_pairs

    path = scratch_path(spark, "merges")
    pairs = table(spark, folder, "documents").select(F.inline(token_pairs(words("text"))))
    top = pairs.groupBy("prev", "cur").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prev", "cur")
    # the sorted parts' names are in order, and so the merges are read
    top.select(F.concat_ws(" ", "prev", "cur").alias("value")).write.text(path)
    return scans.load_merges(spark, path, first=120)


@query(
    "resolve_source",
    f"""
    SELECT d.lang, docs,
           CASE WHEN d.lang = 'en' THEN 'HuggingFaceFW/fineweb' ELSE 'HuggingFaceFW/fineweb-2' END AS dataset,
           CASE WHEN d.lang <> 'en' THEN fineweb_code END AS config, fineweb_est_gb::DOUBLE AS est_gb
    FROM (SELECT lang, count(*) AS docs FROM documents GROUP BY lang) d JOIN {LANGUAGE_SQL} ON m.lang = d.lang
    """,
)
def resolve_source(spark, folder):
    docs = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    return languages.resolve_source(docs, "fineweb")


@query(
    "sink_jsonl",
    """
    SELECT CASE WHEN (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 10 = 0
                THEN 'dev' ELSE 'train' END AS split, source AS language, text
    FROM (SELECT doc_id, source, trim(text, E' \\t\\n\\r') AS text FROM documents)
    """,
)
def sink_jsonl(spark, folder):
    path = scratch_path(spark, "jsonl")
    docs = table(spark, folder, "documents")
    rows = modulo_dev_split(docs, file="source", every=10, max_chars=1_000_000)
    sinks.write_jsonl(rows, path, language="source")
    return spark.read.schema("text string, language string, split string").json(path)


@query(
    "sink_text_lines",
    """
    SELECT lang, split, count(*) AS lines, sum(strlen(line) + 1)::BIGINT AS bytes
    FROM (SELECT lang, CASE WHEN lang = 'en' THEN 'val' ELSE 'train' END AS split,
                 unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents)
    GROUP BY lang, split
    """,
)
def sink_text_lines(spark, folder):
    path = scratch_path(spark, "lines")
    docs = table(spark, folder, "documents")
    split = F.when(F.col("lang") == "en", "val").otherwise("train")
    sinks.write_text(docs.select("lang", split.alias("split"), "text"), path)
    lines = spark.read.option("lineSep", "\n").schema("value string, lang string, split string").text(path)
    return lines.groupBy("lang", "split").agg(
        F.count("*").alias("lines"), F.sum(utf8_bytes("value") + 1).alias("bytes")
    )


@query(
    "vocab_ids",
    """
    WITH w AS (SELECT unnest(regexp_extract_all(text, '\\S+')) AS token FROM documents),
         t AS (SELECT token, count(*) AS n FROM w GROUP BY token)
    SELECT token, (row_number() OVER (ORDER BY n DESC, hex(encode(token))) + 4)::INTEGER AS id FROM t
    UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3), ('<mask>', 4))
    """,
)
def vocab_ids(spark, folder):
    from lingua_spark.learn.wordtable import word_counts

    counts = word_counts(table(spark, folder, "documents"), preset="words")
    tokens = counts.withColumnRenamed("word", "token")
    order = [-F.col("freq"), F.hex(F.encode("token", "UTF-8"))]
    return sinks.vocabulary(spark, tokens, order)


@query(
    "resume_pending",
    """
    SELECT DISTINCT lang || source AS lang FROM documents
    WHERE lang || source NOT IN (SELECT lang || source FROM documents GROUP BY ALL HAVING count(*) >= 10)
    """,
)
def resume_pending(spark, folder):
    name = F.concat("lang", "source").alias("lang")
    by_source = table(spark, folder, "documents").groupBy(name).count()
    done = stage(by_source.filter("count >= 10").select("lang"), "manifest")
    return sinks.pending(by_source.select("lang"), done)


@query(
    "lang_sets",
    f"""
    WITH s(lang_set, position, lang) AS (VALUES {values([(n, i, c) for n, cs in languages.LANG_SETS.items() for i, c in enumerate(cs)])}),
         d AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang)
    SELECT lang_set, position::INTEGER AS position, s.lang, coalesce(docs, 0)::BIGINT AS docs FROM s LEFT JOIN d ON s.lang = d.lang
    """,
)
def lang_sets(spark, folder):
    docs = table(spark, folder, "documents").groupBy("lang").agg(F.count("*").alias("docs"))
    return languages.lang_set_table(spark).join(docs, "lang", "left").fillna({"docs": 0})


@query("lang_set_filter", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def lang_set_filter(spark, folder):
    return languages.filter_lang_set(table(spark, folder, "documents"), "en, de,xx").select("doc_id", "lang")


@query(
    "lang_lookup",
    f"""
    SELECT d.doc_id, d.lang, m.flores_code, m.cc100_code, m.fineweb_est_gb::DOUBLE AS fineweb_est_gb
    FROM (SELECT doc_id, CASE WHEN source = 'src0' THEN 'qq' ELSE lang END AS lang FROM documents) d
    JOIN {LANGUAGE_SQL} ON m.lang = d.lang
    """,
)
def lang_lookup(spark, folder):
    docs = table(spark, folder, "documents")
    coded = docs.select("doc_id", F.when(F.col("source") == "src0", "qq").otherwise(F.col("lang")).alias("lang"))
    return languages.with_language(coded).select("doc_id", "lang", "flores_code", "cc100_code", "fineweb_est_gb")


@query("lang_lookup_skipped", "SELECT doc_id, 'qq' AS lang FROM documents WHERE source = 'src0'")
def lang_lookup_skipped(spark, folder):
    docs = table(spark, folder, "documents")
    coded = docs.select("doc_id", F.when(F.col("source") == "src0", "qq").otherwise(F.col("lang")).alias("lang"))
    return languages.with_language(coded, known=False)
