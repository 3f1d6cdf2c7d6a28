"""The queries opN_<name> of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.llm import (
    bpe_prefix,
    byte_shards,
    chosen_path,
    decontaminate,
    hard_negatives,
    language_id,
    maxent_lm,
    pii_boost,
    quality_rules,
    token_counts,
    url_rules,
    warc_archive,
    whitening,
)
from lingua_spark.queries.registry import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_url_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge(table(spark, folder, "pages"), table(spark, folder, "labels"))


@query("op2_pii_boost")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return pii_boost.find_pii(table(spark, folder, "documents"))


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS original FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op3_warc_archive", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return warc_archive.round_trip(table(spark, folder, "pages"))


@query("op4_byte_shards")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    shards = byte_shards.byte_shards(table(spark, folder, "documents"), 16)
    return shards.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@query("op5_decontaminate")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op6_bpe_prefix")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_prefix.digest(table(spark, folder, "documents"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query("op8_chosen_path")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return chosen_path.similar(table(spark, folder, "documents"))


@query("op9_maxent_lm")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return maxent_lm.score(table(spark, folder, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality(table(spark, folder, "documents"))


@query("op11_token_counts")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


OP13_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         list_inner_product(a.v, b.v)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    mixed = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(mixed, F.col("vec_id") % 100 == 0)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline  # stands at the top of the repository and imports this package

    return corpus_pipeline.run(spark, folder)
