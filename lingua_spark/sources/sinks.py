"""Writers: JSONL, text per language and split, manifest, tokenizer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS
from lingua_spark.operators.ordered import position
from lingua_spark.runtime import stage


def write_jsonl(df: DataFrame, path: str, text: str = "text", language: str = "language") -> None:
    """{text, language} records, one folder per split."""
    df.select(F.col(text).alias("text"), F.col(language).alias("language"), "split").write.partitionBy(
        "split"
    ).json(path)


def write_text(df: DataFrame, path: str, by: tuple[str, ...] = ("lang", "split"), escape: bool = False) -> None:
    """One line per text below ``<by>`` folders.

    A text with inner newlines reads back as several lines, as in any line
    corpus; ``escape`` writes them as ``\\n`` instead.
    """
    value = F.col("text")
    if escape:
        value = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    # The line writer adds the newline, so one at the end of the text is dropped.
    value = F.regexp_replace(value, r"\n\z", "")
    # Folders that get new texts are replaced, others stay.
    (
        df.select(value.alias("value"), *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .text(path)
    )


def manifest(splits: DataFrame, targets: DataFrame, floor: int = 0, lang: str = "lang") -> DataFrame:
    """Per language: target, written bytes, lines per split and a floor flag.

    ``splits`` has lang, split and bytes; one partial aggregate per split.
    """
    counts = splits.groupBy(lang).agg(
        F.sum("bytes").alias("bytes_written"),
        *[
            F.count_if(F.col("split") == s).alias(f"{s}_lines")
            for s in ("train", "val", "test")
        ],
    )
    joined = targets.select(lang, "target_bytes").join(counts, lang, "left")
    zero = {c: 0 for c in ("bytes_written", "train_lines", "val_lines", "test_lines")}
    return joined.fillna(zero).withColumn("under_floor", F.col("train_lines") < floor)


def manifest_struct(table: DataFrame, dataset: str, lang: str = "lang") -> DataFrame:
    """The manifest in its nested on-disk form."""
    lines = F.create_map(
        *[x for s in ("train", "val", "test") for x in (F.lit(s), F.col(f"{s}_lines"))]
    )
    return table.select(
        F.col(lang).alias("language"),
        F.lit(dataset).alias("dataset"),
        "target_bytes",
        "bytes_written",
        lines.alias("lines"),
    )


MANIFEST = (
    "language string, dataset string, target_bytes bigint, bytes_written bigint, lines map<string,bigint>"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of earlier runs; None if there is none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(MANIFEST).json(path)


def pending(todo: DataFrame, done: DataFrame, lang: str = "lang") -> DataFrame:
    """What is not yet in the manifest, for an idempotent re-run."""
    return todo.join(done.select(lang), lang, "left_anti")


def vocabulary(
    spark: SparkSession, tokens: DataFrame, order: list[Column], special: list[str] | None = None
) -> DataFrame:
    """(token, id): special tokens first, then ``tokens`` by the ascending keys
    in ``order``.

    Numbered block by block, so that any number of tokens is fine.
    """
    special = SPECIAL_TOKENS if special is None else special
    keyed = tokens.select("token", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)]).alias("_key"))
    rows = position(stage(keyed, "vocabulary"), [], "_key", "n")
    numbered = rows.select("token", (F.col("n") - 1 + len(special)).cast("int").alias("id"))
    if not special:
        return numbered
    first = spark.createDataFrame([(t, i) for i, t in enumerate(special)], "token string, id int")
    return first.unionByName(numbered)


def write_summary(summary: DataFrame, path: str) -> None:
    """A correlation summary (one row per size pair) as CSV and JSON."""
    small = summary.coalesce(1)
    small.write.option("header", True).csv(f"{path}/csv")
    small.write.json(f"{path}/json")


def write_tokenizer(model, path: str) -> None:
    """The model's tables as Parquet: merges, vocabulary and, where the
    learner has them, events and log-probabilities."""
    for name, table in model.tables().items():
        table.write.parquet(f"{path}/{name}")
