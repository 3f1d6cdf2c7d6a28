"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import pretokens
from lingua_spark.functions.text import words
from lingua_spark.learn.wordtable import word_counts
from lingua_spark.operators import corpus, mixing, ordered
from lingua_spark.operators.corpus import SplitOptions
from lingua_spark.operators.sequences import pack_chunks
from lingua_spark.plans.fairness import fairness_report
from lingua_spark.queries.corpus import share_targets

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_only_needed_columns_are_read(docs):
    report = fairness_report(docs, {"words": words("text")})
    assert set(re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(report))) == {"text:string,lang:string"}
    assert "ReadSchema: struct<text:string>" in plan_of(word_counts(docs, preset="whitespace"))


def test_filters_reach_the_scan(docs):
    from lingua_spark.sources.languages import filter_lang_set

    assert re.search(r"PushedFilters: \[[^\]]*In\(lang, \[", plan_of(filter_lang_set(docs, "en,de").select("doc_id")))


def test_text_work_needs_no_python_and_no_shuffle(docs):
    for df in (
        docs.select(pretokens("text", "gpt4")),
        pack_chunks(docs.select("doc_id", words("text").alias("input_ids"))),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan


def test_counts_are_partial_before_the_shuffle(docs):
    plan = plan_of(word_counts(docs, preset="words"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_count" in plan


def test_positions_never_meet_in_one_task(docs):
    narrow = docs.select("doc_id", "lang", F.col("lang").alias("source"))
    for df in (
        ordered.position(narrow, ["lang"], "doc_id"),
        mixing.interleave(narrow),
        mixing.take_skip(narrow, 20),
    ):
        assert "SinglePartition" not in plan_of(df)
    plan = plan_of(ordered.position(narrow, ["lang"], "doc_id"))
    # The only window without the block in its key runs over block sums.
    windows = re.findall(r"Window \[.*?windowspecdefinition\((.*?)\)", plan)
    assert any("_block" in w.split("ASC")[0] for w in windows)


def test_budget_split_moves_no_text(docs):
    frame = docs.select("doc_id", "lang", "text")
    out = corpus.budget_split(frame, share_targets(frame, 0.4), SplitOptions(0.1, 0.1, 3, 5))
    plan = plan_of(out)
    assert "hashpartitioning" not in plan and "SinglePartition" not in plan
    assert "BroadcastHashJoin" in plan


def test_dev_split_by_file_is_map_only(spark):
    from lingua_spark.sources.scans import scan_parquet_files

    rows = scan_parquet_files(spark, FOLDER, "documents.parquet")
    assert "Exchange" not in plan_of(corpus.modulo_dev_split(rows, index="row_index"))


def test_no_join_without_keys(docs, spark):
    from lingua_spark.operators import compare
    from lingua_spark.operators.matching import parallel_route, parallel_targets
    from lingua_spark.sources.languages import language_table

    rows = docs.select(F.col("lang").alias("iso_639_3"), F.lit("Latn").alias("iso_15924"), "text")
    means = compare.seed_means(spark.read.parquet(f"{FOLDER}/lineitem.parquet"), "l_returnflag", "l_suppkey", "l_quantity")
    for df in (parallel_route(rows, parallel_targets(language_table(spark))), compare.merge_sizes(means)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
