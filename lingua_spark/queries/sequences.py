"""Token sequences in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingua_spark.functions.text import words
from lingua_spark.operators import sequences
from lingua_spark.queries.registry import query, table
from lingua_spark.runtime import scratch_path
from lingua_spark.streaming import ingest

WORDS = r"regexp_extract_all(text, '\S+')"


def _tokens(spark, folder):
    return table(spark, folder, "documents").select("doc_id", words("text").alias("input_ids"))


@query(
    "truncate_tokens",
    f"SELECT doc_id, array_to_string({WORDS}[1:128], ' ') AS tokens, least(len({WORDS}), 128)::INTEGER AS n FROM documents",
)
def truncate_tokens(spark, folder):
    cut = sequences.truncate("input_ids", 128)
    return _tokens(spark, folder).select("doc_id", F.array_join(cut, " ").alias("tokens"), F.size(cut).alias("n"))


_CHUNKS_SQL = f"""
    SELECT doc_id, i::INTEGER AS chunk_no, array_to_string(w[i * 64 + 1 : i * 64 + 64], ' ') AS tokens
    FROM (SELECT doc_id, w, unnest(range(0, len(w) // 64)) AS i FROM (SELECT doc_id, {WORDS} AS w FROM documents))
"""


@query("pack_chunks", _CHUNKS_SQL)
def pack_chunks(spark, folder):
    chunks = sequences.pack_chunks(_tokens(spark, folder), max_length=64)
    return chunks.select("doc_id", "chunk_no", F.array_join("input_ids", " ").alias("tokens"))


@query(
    "chunk_yield",
    f"""
    SELECT lang, count(*) AS docs, count(*) FILTER (n >= 512) AS docs_with_chunk, sum(n // 512)::BIGINT AS chunks,
           sum(n % 512)::BIGINT AS tokens_dropped, sum(n)::BIGINT AS tokens,
           round(avg(CASE WHEN n >= 512 THEN 1.0 ELSE 0.0 END), 6) AS share
    FROM (SELECT lang, len({WORDS}) AS n FROM documents) GROUP BY lang
    """,
)
def chunk_yield(spark, folder):
    tokens = table(spark, folder, "documents").select("lang", words("text").alias("input_ids"))
    return sequences.chunk_yield(tokens, max_length=512, by=("lang",))


@query("stream_chunks", _CHUNKS_SQL)
def stream_chunks(spark, folder):
    docs = table(spark, folder, "documents")
    source, sink = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    docs.repartition(8).write.parquet(source)
    rows = ingest.read_folder(spark, source, docs.schema, max_files_per_trigger=3)
    chunks = ingest.chunk_stream(rows, words("text"), keep=("doc_id",), max_length=64)
    ingest.write_stream(chunks, sink, scratch_path(spark, "stream-log")).awaitTermination()
    written = spark.read.schema(chunks.schema).parquet(sink)
    return written.select("doc_id", "chunk_no", F.array_join("input_ids", " ").alias("tokens"))


@query("stream_counts", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def stream_counts(spark, folder):
    docs = table(spark, folder, "documents")
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "counts")
    docs.select("source", "text").repartition(6).write.parquet(source)
    rows = ingest.read_folder(spark, source, "source string, text string", max_files_per_trigger=2)
    ingest.count_stream(rows, out, scratch_path(spark, "stream-log")).awaitTermination()
    return ingest.read_counts(spark, out)


@query("stream_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_event_counts(spark, folder):
    events = table(spark, folder, "events")
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "counts")
    events.select("event_type").repartition(4).write.parquet(source)
    rows = ingest.read_folder(spark, source, "event_type string", max_files_per_trigger=2)
    ingest.count_stream(rows, out, scratch_path(spark, "stream-log"), by=("event_type",)).awaitTermination()
    return ingest.read_counts(spark, out)


@query(
    "flat_map",
    """
    SELECT doc_id, i::INTEGER AS line_no, len(l)::INTEGER AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
          FROM documents)
    """,
)
def flat_map(spark, folder):
    """A user's function that gives any number of rows per text."""

    def lines(text):
        for number, line in enumerate((text or "").split("\n")):
            yield number, len(line)

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sequences.flat_map(docs, lines, "line_no int, chars int", "text").drop("text")
