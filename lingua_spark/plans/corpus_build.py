"""Corpus build: shares, byte targets, split corpus, manifest, tokenizer sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingua_spark.functions.text import utf8_bytes
from lingua_spark.operators.corpus import (
    SplitOptions,
    budget_split,
    byte_targets,
    lang_proportions,
    tokenizer_sample,
)
from lingua_spark.runtime import stage
from lingua_spark.sources.languages import estimated_gb, filter_lang_set, language_table
from lingua_spark.sources.sinks import manifest, manifest_struct, pending, read_manifest, write_text


@dataclass
class Corpus:
    splits: DataFrame  # the input columns and ``split``
    targets: DataFrame  # lang, target_bytes
    manifest: DataFrame


def corpus_targets(
    spark, lang_set: str, dataset: str = "fineweb", total_gb: float = 100.0, temperature: float = 5.0, cap: float = 0.5
) -> DataFrame:
    """Byte targets of a language set from the estimated sizes."""
    langs = filter_lang_set(language_table(spark), lang_set)
    sizes = langs.select("lang", estimated_gb(dataset).alias("size"))
    return byte_targets(lang_proportions(sizes, temperature, cap), total_gb)


def build_corpus(
    df: DataFrame,
    targets: DataFrame,
    options: SplitOptions | None = None,
    order: str = "doc_id",
    text: str = "text",
) -> Corpus:
    """All languages in one plan: split the rows within their byte targets and
    count what was taken."""
    options = options or SplitOptions()
    targets = stage(targets, "targets")
    splits = budget_split(df, targets, options, order=order, text=text)
    sized = splits.select("lang", "split", utf8_bytes(text, True).alias("bytes"))
    return Corpus(splits, targets, manifest(sized, targets, options.min_lines_floor))


def write_corpus(
    corpus: Corpus,
    path: str,
    tokenizer_gb: float = 0.0,
    temperature: float = 1.0,
    seed: int = 42,
    dataset: str = "fineweb",
) -> None:
    """Write the texts per language and split, the tokenizer sample of the
    training texts, and the manifest.

    Languages in the manifest of an earlier run are left alone. The manifest is
    written last: a run that broke off leaves its languages out, and the next
    one replaces what it had written of them.
    """
    done = read_manifest(corpus.targets.sparkSession, f"{path}/manifest")
    todo = corpus.targets if done is None else pending(corpus.targets, done.withColumnRenamed("language", "lang"))
    todo = stage(todo.select("lang"), "todo")
    splits = corpus.splits.join(todo, "lang", "left_semi")
    write_text(splits.select("lang", "split", "text"), f"{path}/main")
    if tokenizer_gb > 0:
        train = splits.filter(F.col("split") == "train")
        sample = tokenizer_sample(train, tokenizer_gb, temperature, seed)
        write_text(sample.select("lang", "split", "text"), f"{path}/tokenizer")
    rows = corpus.manifest.join(todo, "lang", "left_semi")
    manifest_struct(rows, dataset).write.mode("append").json(f"{path}/manifest")
