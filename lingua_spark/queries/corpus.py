"""Corpus building, splits, samples and mixing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingua_spark.functions.text import strip, utf8_bytes
from lingua_spark.operators import corpus, matching, mixing
from lingua_spark.operators.corpus import SplitOptions
from lingua_spark.plans.corpus_build import build_corpus, write_corpus
from lingua_spark.queries.registry import HASH, query, table, values
from lingua_spark.queries.sources import LANGUAGE_SQL
from lingua_spark.runtime import scratch_path, stage
from lingua_spark.sources.languages import language_table
from lingua_spark.sources.scans import scan_parquet_files, scan_parquet_folders
from lingua_spark.sources.sinks import read_manifest

LINE_BYTES = "(strlen(text) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT"
STRIP = "trim(text, E' \\t\\n\\r')"


def split_sql(target: str, vf: float, tf: float, cap: int, floor: int) -> str:
    """Budget, floor and capped split by windows; ``target`` per language."""
    return f"""
    d AS (SELECT doc_id, lang, {LINE_BYTES} AS bytes, {HASH.format(purpose="split", key="doc_id")} AS r FROM documents),
    t AS ({target}),
    c AS (SELECT d.*, target_bytes, sum(bytes) OVER (PARTITION BY d.lang ORDER BY doc_id) <= target_bytes AS inside
          FROM d JOIN t ON t.lang = d.lang),
    v AS (SELECT *, row_number() OVER (PARTITION BY lang, inside, r < {vf} ORDER BY doc_id) AS vr FROM c),
    x AS (SELECT *, inside AND r < {vf} AND vr <= {cap} AS is_val,
                 inside AND ((r < {vf} AND vr > {cap}) OR (r >= {vf} AND r < {vf + tf})) AS may_test FROM v),
    y AS (SELECT *, row_number() OVER (PARTITION BY lang, may_test ORDER BY doc_id) AS tr FROM x),
    z AS (SELECT *, CASE WHEN is_val THEN 'val' WHEN may_test AND tr <= {cap} THEN 'test' ELSE 'train' END AS split,
                 row_number() OVER (PARTITION BY lang, inside ORDER BY doc_id) AS k FROM y),
    n AS (SELECT lang, count(*) FILTER (inside AND split = 'train') AS t0 FROM z GROUP BY lang),
    splits AS (SELECT z.doc_id, z.lang, z.bytes, z.split FROM z JOIN n ON n.lang = z.lang
               WHERE inside OR k <= {floor} - t0)
    """


def share_target(share: float) -> str:
    return f"SELECT lang, floor({share}::DOUBLE * sum(bytes))::BIGINT AS target_bytes FROM d GROUP BY lang"


def share_targets(docs, share):
    total = F.sum(utf8_bytes("text", True))
    return docs.groupBy("lang").agg(F.floor(F.lit(float(share)) * total).cast("bigint").alias("target_bytes"))


def _split_query(name, share, vf, tf, cap, floor):
    sql = f"WITH {split_sql(share_target(share), vf, tf, cap, floor)} SELECT doc_id, lang, split FROM splits"

    @query(name, sql)
    def run(spark, folder):
        docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
        options = SplitOptions(vf, tf, cap, floor)
        out = corpus.budget_split(docs, share_targets(docs, share), options, ties=[])  # ids are unique
        return out.select("doc_id", "lang", "split")


_split_query("byte_budget", 0.4, 0.0, 0.0, 3000, 0)
_split_query("byte_budget_floor", 0.2, 0.05, 0.05, 4, 90)
_split_query("split_capped", 2.0, 0.05, 0.05, 6, 0)


# An order column with nulls and ties; the row id breaks the ties.
_TIED = "nullif(doc_id // 4, 3)"


def _tied(docs):
    quarter = F.floor(F.col("doc_id") / 4).cast("bigint")
    return docs.withColumn("place", F.nullif(quarter, F.lit(3).cast("bigint")))


@query(
    "byte_budget_ties",
    "WITH "
    + split_sql(share_target(0.3), 0.05, 0.05, 4, 60).replace("ORDER BY doc_id", f"ORDER BY {_TIED} NULLS FIRST, doc_id")
    + " SELECT doc_id, lang, split FROM splits",
)
def byte_budget_ties(spark, folder):
    docs = _tied(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    options = SplitOptions(0.05, 0.05, 4, 60)
    out = corpus.budget_split(
        docs, share_targets(docs, 0.3), options, order="place", ties=["doc_id"], draw="doc_id"
    )
    return out.select("doc_id", "lang", "split")


@query(
    "first_n_ties",
    f"""
    WITH h AS (SELECT doc_id, lang, {STRIP} AS text, {_TIED} AS place FROM documents
               ORDER BY place NULLS FIRST, doc_id LIMIT 200)
    SELECT doc_id, lang FROM h WHERE text <> ''
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY place NULLS FIRST, doc_id) <= 10
    """,
)
def first_n_ties(spark, folder):
    docs = _tied(table(spark, folder, "documents").select("doc_id", "lang", "text"))
    return corpus.first_n_per_lang(docs, 10, order="place", ties=["doc_id"]).select("doc_id", "lang")


_SAMPLED = 0.03  # below the held-out share of 0.1


@query(
    "corpus_tokenizer_sample",
    f"""
    WITH {split_sql(share_target(0.8), 0.05, 0.05, 1000000, 0)},
         s AS (SELECT lang, sum(bytes) AS size FROM splits WHERE split = 'train' GROUP BY lang),
         p AS (SELECT lang, size, size::DOUBLE / sum(size::DOUBLE) OVER () AS share, sum(size) OVER () AS total FROM s),
         q AS (SELECT lang, least(1.0, floor({_SAMPLED}::DOUBLE * total / 1073741824 * share * 1073741824) / size) AS rate FROM p)
    SELECT doc_id, x.lang FROM splits x JOIN q ON q.lang = x.lang
    WHERE split = 'train' AND {HASH.format(purpose="sample", key="doc_id")} < rate
    """,
)
def corpus_tokenizer_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    built = build_corpus(docs, share_targets(docs, 0.8), SplitOptions(0.05, 0.05, 1_000_000))
    train = stage(built.splits.filter("split = 'train'"), "train")
    total = train.agg(F.sum(utf8_bytes("text", True))).first()[0]
    return corpus.tokenizer_sample(train, _SAMPLED * total / 1024**3, 1.0).select("doc_id", "lang")


@query(
    "corpus_manifest",
    f"""
    WITH {split_sql(share_target(0.3), 0.05, 0.05, 5, 100)}
    SELECT t.lang, t.target_bytes, sum(bytes)::BIGINT AS bytes_written,
           count(*) FILTER (split = 'train') AS train_lines, count(*) FILTER (split = 'val') AS val_lines,
           count(*) FILTER (split = 'test') AS test_lines,
           count(*) FILTER (split = 'train') < 100 AS under_floor
    FROM t JOIN splits ON splits.lang = t.lang GROUP BY t.lang, t.target_bytes
    """,
)
def corpus_manifest(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return build_corpus(docs, share_targets(docs, 0.3), SplitOptions(0.05, 0.05, 5, 100)).manifest


@query(
    "corpus_write_resume",
    f"""
    WITH {split_sql(share_target(0.5), 0.05, 0.05, 5, 0)},
         m AS (SELECT t.lang, t.target_bytes, sum(bytes)::BIGINT AS bytes_written,
                      count(*) FILTER (split = 'train') AS train_lines, count(*) FILTER (split = 'val') AS val_lines
               FROM t JOIN splits ON splits.lang = t.lang GROUP BY t.lang, t.target_bytes)
    SELECT lang AS language, CASE WHEN lang IN ('en', 'fr') THEN 'first' ELSE 'second' END AS dataset, target_bytes,
           bytes_written, train_lines, val_lines FROM m
    """,
)
def corpus_write_resume(spark, folder):
    """A run over two languages, then one over all: the second does the rest."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "corpus")
    options = SplitOptions(0.05, 0.05, 5)
    some = docs.filter(F.col("lang").isin("en", "fr"))
    write_corpus(build_corpus(some, share_targets(some, 0.5), options), path, dataset="first")
    write_corpus(build_corpus(docs, share_targets(docs, 0.5), options), path, dataset="second")
    done = read_manifest(spark, f"{path}/manifest")
    lines = [F.col("lines")[s].alias(f"{s}_lines") for s in ("train", "val")]
    return done.select("language", "dataset", "target_bytes", "bytes_written", *lines)


_SHARES = [(1.0, 0.3), (2.0, 0.3), (5.0, 0.3), (5.0, 0.5), (1.0, 0.1)]


def _share_sql(t: float, cap: float) -> str:
    return f"""
    SELECT '{t:g}/{cap:g}' AS setting, lang, size,
           round(CASE WHEN abs(s - 1) > 1e-5 * greatest(s, 1.0) THEN q / s ELSE q END, 9) AS proportion
    FROM (SELECT *, sum(q) OVER () AS s FROM (
        SELECT *, CASE WHEN hit AND p < {cap} THEN w / sum(CASE WHEN p < {cap} THEN w ELSE 0 END) OVER ()
                            * (1 - sum(CASE WHEN p < {cap} THEN 0 ELSE p END) OVER ()) ELSE p END AS q
        FROM (SELECT lang, size, w, least(w / sum(w) OVER (), {cap}::DOUBLE) AS p,
                     max(w) OVER () / sum(w) OVER () > {cap} AS hit
              FROM (SELECT lang, sum(strlen(text))::BIGINT AS size, pow(sum(strlen(text))::DOUBLE, 1.0 / {t}) AS w
                    FROM documents GROUP BY lang))))
    """


@query("lang_proportions", " UNION ALL ".join(_share_sql(t, c) for t, c in _SHARES))
def lang_proportions(spark, folder):
    sizes = table(spark, folder, "documents").groupBy("lang").agg(F.sum(utf8_bytes("text")).alias("size"))
    out = None
    for t, cap in _SHARES:
        part = corpus.lang_proportions(sizes, t, cap)
        part = part.select(F.lit(f"{t:g}/{cap:g}").alias("setting"), "lang", "size", F.round("proportion", 9).alias("proportion"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "byte_targets",
    f"""
    WITH s AS (SELECT m.lang, m.fineweb_est_gb::DOUBLE AS gb FROM {LANGUAGE_SQL}
               WHERE m.lang IN (SELECT lang FROM documents)),
         p AS (SELECT lang, pow(gb, 0.2) / sum(pow(gb, 0.2)) OVER () AS p FROM s)
    SELECT lang, floor(10.0::DOUBLE * p * 1073741824)::BIGINT AS target_bytes FROM p
    """,
)
def byte_targets(spark, folder):
    langs = table(spark, folder, "documents").select("lang").distinct()
    sizes = language_table(spark).join(langs, "lang", "left_semi")
    shares = corpus.lang_proportions(sizes.withColumnRenamed("fineweb_est_gb", "size"), 5.0, 0.5)
    return corpus.byte_targets(shares, 10.0)


@query(
    "corpus_counts",
    """
    SELECT coalesce(lang, 'TOTAL') AS lang, coalesce(source, 'TOTAL') AS source, count(*) AS lines,
           sum(strlen(text))::BIGINT AS bytes, round(sum(strlen(text)) / 1e9::DOUBLE, 9) AS gb
    FROM documents GROUP BY ROLLUP (lang, source)
    """,
)
def corpus_counts(spark, folder):
    return corpus.corpus_counts(table(spark, folder, "documents"), ("lang", "source"))


@query(
    "lang_order",
    """
    SELECT lang, row_number() OVER (ORDER BY first_seen) - 1 AS position, first_seen, samples
    FROM (SELECT lang, min(doc_id) AS first_seen,
                 count(*) FILTER (lang <> 'de' AND trim(text) <> '') AS samples FROM documents GROUP BY lang)
    """,
)
def lang_order(spark, folder):
    docs = table(spark, folder, "documents")
    # One language of blank texts only must still be listed.
    blanked = docs.withColumn("text", F.when(F.col("lang") == "de", " \n").otherwise(F.col("text")))
    return corpus.lang_order(blanked)


@query(
    "tokenizer_sample",
    f"""
    WITH d AS (SELECT doc_id, lang, {LINE_BYTES} AS bytes, {HASH.format(purpose="sample", key="doc_id")} AS r FROM documents),
         s AS (SELECT lang, sum(bytes) AS size FROM d GROUP BY lang),
         p AS (SELECT lang, size, pow(size::DOUBLE, 0.5) / sum(pow(size::DOUBLE, 0.5)) OVER () AS share FROM s),
         q AS (SELECT lang, least(1.0, floor(0.0008::DOUBLE * share * 1073741824) / size) AS rate FROM p)
    SELECT doc_id, d.lang FROM d JOIN q ON q.lang = d.lang WHERE r < rate
    """,
)
def tokenizer_sample(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return corpus.tokenizer_sample(docs, 0.0008, 2.0).select("doc_id", "lang")


@query(
    "first_n_per_lang",
    f"""
    WITH h AS (SELECT doc_id, lang, {STRIP} AS text FROM documents ORDER BY doc_id LIMIT 600)
    SELECT doc_id, lang, text FROM h WHERE text <> ''
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 30
    """,
)
def first_n_per_lang(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    return corpus.first_n_per_lang(docs, 30)


def _dev_sql(index: str, file: str) -> str:
    return f"""
    SELECT {file} AS file, doc_id, CASE WHEN {index} % 10 = 0 THEN 'dev' ELSE 'train' END AS split, {STRIP} AS text
    FROM documents WHERE {STRIP} <> ''
    """


@query(
    "modulo_dev_split",
    _dev_sql("(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)", "source"),
)
def modulo_dev_split(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    out = corpus.modulo_dev_split(docs, file="source", every=10, max_chars=10_000_000)
    return out.select(F.col("source").alias("file"), "doc_id", "split", "text")


@query("modulo_dev_split_by_file", _dev_sql("doc_id", "'documents'"))
def modulo_dev_split_by_file(spark, folder):
    docs = scan_parquet_files(spark, folder, "documents.parquet")
    out = corpus.modulo_dev_split(docs, index="row_index", every=10, max_chars=10_000_000)
    return out.select(F.col("language").alias("file"), "doc_id", "split", "text")


# The first 200 rows of one language form a source that runs dry early.
_SOURCES_SQL = """
    SELECT doc_id, lang AS source, count(*) OVER (PARTITION BY lang) AS n,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank,
           dense_rank() OVER (ORDER BY lang) AS idx FROM documents
"""
_PLACE = "(rank - 1) * (SELECT count(DISTINCT lang) FROM documents) + idx"
_LAST = "(n - 1) * (SELECT count(DISTINCT lang) FROM documents) + idx"


@query(
    "interleave",
    f"""
    WITH s AS ({_SOURCES_SQL}), p AS (SELECT *, {_PLACE} AS position, {_LAST} AS last FROM s)
    SELECT doc_id, source, position FROM p WHERE position <= (SELECT min(last) FROM p)
    """,
)
def interleave(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("source"))
    return mixing.interleave(docs, ties=[])


@query(
    "interleave_all",
    f"""
    WITH s AS ({_SOURCES_SQL}), l AS (SELECT max({_LAST}) AS stop FROM s),
         k AS (SELECT count(DISTINCT lang) AS k FROM documents),
         r AS (SELECT doc_id, source, idx, k, unnest(range(rank, (stop - idx) // k + 2, n)) AS round FROM s, l, k)
    SELECT doc_id, source, ((round - 1) * k + idx)::BIGINT AS position FROM r
    """,
)
def interleave_all(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("source"))
    return mixing.interleave(docs, stopping="all_exhausted", ties=[])


@query(
    "take_skip_ties",
    f"""
    WITH s AS ({_SOURCES_SQL.replace("ORDER BY doc_id", f"ORDER BY {_TIED} NULLS FIRST, doc_id")}),
         p AS (SELECT *, {_PLACE} AS position, {_LAST} AS last FROM s)
    SELECT doc_id, source, CASE WHEN position <= 102 THEN 'eval' ELSE 'train' END AS part
    FROM p WHERE position <= (SELECT min(last) FROM p)
    """,
)
def take_skip_ties(spark, folder):
    docs = _tied(table(spark, folder, "documents").select("doc_id", F.col("lang").alias("source")))
    return mixing.take_skip(docs, 102, order="place", ties=["doc_id"]).drop("place")


@query(
    "take_skip",
    f"""
    WITH s AS ({_SOURCES_SQL}), p AS (SELECT *, {_PLACE} AS position, {_LAST} AS last FROM s)
    SELECT doc_id, source, CASE WHEN position <= 101 THEN 'eval' ELSE 'train' END AS part
    FROM p WHERE position <= (SELECT min(last) FROM p)
    """,
)
def take_skip(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("source"))
    return mixing.take_skip(docs, 101, ties=[])


@query(
    "interleave_file_order",
    f"""
    WITH s AS ({_SOURCES_SQL}), p AS (SELECT *, {_PLACE} AS position, {_LAST} AS last FROM s)
    SELECT doc_id, source, position FROM p WHERE position <= (SELECT min(last) FROM p)
    """,
)
def interleave_file_order(spark, folder):
    """A tree of Parquet folders, read in the order of its files and rows."""
    path = scratch_path(spark, "tree")
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    tasks = max(4, -(-docs.count() // 20_000))  # whose files, 100 rows each, keep numbers of three digits
    rows = docs.repartitionByRange(tasks, "lang", "doc_id").sortWithinPartitions("lang", "doc_id")
    rows.write.partitionBy("lang").option("maxRecordsPerFile", 100).parquet(path)
    scanned = scan_parquet_folders(spark, path, ("doc_id",), with_place=True)
    scanned = scanned.withColumn("source", F.regexp_replace("source", "^lang=", ""))
    mixed = mixing.interleave(scanned.drop("text"), order=["file", "row_index"], ties=[])
    return mixed.select("doc_id", "source", "position")


_PARALLEL = [("en", "en", None), ("en-latin", "en", "Latn"), ("de-latin", "de", "Latn"), ("fr-cyrillic", "fr", "Cyrl")]


@query(
    "parallel_route",
    f"""
    WITH t(target, iso, script) AS (VALUES {values(_PARALLEL)}),
         r AS (SELECT doc_id, lang AS iso_639_3, CASE WHEN source < 'src15' THEN 'Latn' ELSE 'Cyrl' END AS iso_15924 FROM documents)
    SELECT doc_id, target, iso_639_3, iso_15924 FROM r JOIN t
    ON iso_639_3 = iso AND (script IS NULL OR script = iso_15924)
    """,
)
def parallel_route(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.col("lang").alias("iso_639_3"),
        F.when(F.col("source") < "src15", "Latn").otherwise("Cyrl").alias("iso_15924"),
        "text",
    )
    targets = spark.createDataFrame(_PARALLEL, "target string, iso string, script string")
    return matching.parallel_route(rows, targets, "target").drop("text")


@query(
    "write_parallel",
    f"""
    SELECT m.lang, 'dev' AS split, count(*) AS lines, sum(strlen(line))::BIGINT AS bytes
    FROM (SELECT lang, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents) d
    JOIN {LANGUAGE_SQL} ON m.lang = d.lang GROUP BY m.lang
    """,
)
def write_parallel(spark, folder):
    from lingua_spark.sources.sinks import write_text

    docs = table(spark, folder, "documents")
    targets = matching.parallel_targets(language_table(spark))
    codes = targets.select(F.col("lang").alias("code"), "iso", "script")
    rows = docs.join(F.broadcast(codes), docs["lang"] == F.col("code")).select(
        F.col("iso").alias("iso_639_3"), F.col("script").alias("iso_15924"), "text"
    )
    path = scratch_path(spark, "parallel")
    routed = matching.parallel_route(rows, targets).select("lang", F.lit("dev").alias("split"), "text")
    write_text(routed, path, by=("split", "lang"))
    lines = spark.read.option("lineSep", "\n").schema("value string, split string, lang string").text(path)
    return lines.groupBy("lang", "split").agg(
        F.count("*").alias("lines"), F.sum(F.octet_length("value")).cast("bigint").alias("bytes")
    )


@query(
    "parallel_align",
    """
    WITH p AS (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS position
               FROM conversations)
    SELECT a.position, a.text AS "user", b.text AS assistant
    FROM p a JOIN p b ON a.position = b.position AND a.role = 'user' AND b.role = 'assistant'
    """,
)
def parallel_align(spark, folder):
    turns = table(spark, folder, "conversations")
    ordered = turns.select((F.col("conv_id") * 100000 + F.col("turn")).alias("doc_id"), "role", "text")
    return matching.parallel_align(ordered, ["user", "assistant"], lang="role")


@query(
    "lang_parity_check",
    """
    WITH a AS (SELECT lang, row_number() OVER (ORDER BY min(doc_id)) - 1 AS p FROM documents GROUP BY lang),
         b AS (SELECT lang, row_number() OVER (ORDER BY min(-doc_id)) - 1 AS p FROM documents
               WHERE lang <> 'de' GROUP BY lang)
    SELECT coalesce(a.lang, b.lang) AS lang, a.p AS train_position, b.p AS dev_position,
           coalesce(a.p = b.p, false) AS matches
    FROM a FULL JOIN b ON a.lang = b.lang
    """,
)
def lang_parity_check(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    # Development data in another order and without one language.
    dev = docs.filter(F.col("lang") != "de").withColumn("doc_id", -F.col("doc_id"))
    return matching.lang_parity_check(docs, dev)


@query(
    "text_positions",
    f"""
    SELECT doc_id, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position,
           sum(length({STRIP})) OVER (PARTITION BY lang ORDER BY doc_id)::BIGINT AS running FROM documents
    """,
)
def text_positions(spark, folder):
    from lingua_spark.operators.ordered import block_bounds, position, running_total

    docs = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", F.length(strip("text")).cast("bigint").alias("n")
    )
    bounds = block_bounds(docs, "doc_id", 16)
    placed = position(docs, ["lang"], "doc_id", "position", bounds)
    return running_total(placed, ["lang"], "doc_id", "n", "running", bounds).drop("lang", "n")
