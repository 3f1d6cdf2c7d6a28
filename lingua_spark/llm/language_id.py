"""Language of web pages by Bayesian evidence fusion.

For each language l that the labelled documents know, a page's posterior is

    P(l | page) ~ P(text | l)^t * P(declared | l) * P(suffix | l) * P(l | host)

Text: hashed byte trigrams, counted per language over all labelled documents
and smoothed. Trigrams of a text are not independent, so its likelihood counts
as that of sqrt(n) trigrams. The other factors are learned from the pages
themselves: the text alone gives each page soft counts, and grouped sums of
these give how often pages of a language declare a markup language, and on which
address suffix they stand. The host's prior is smoothed towards its domain's and
that towards the prior of all pages, each with ``strength`` pseudo-pages; a page
does not count in its own prior.

The trigram table has a fixed size per language and is the only thing broadcast.
Hosts, domains, suffixes and declarations are joined as tables of sparse counts,
summed in each task before the shuffle; pages join them without their html.

Defined cases: a null or empty html has no text and the other evidence decides;
a null address has an empty host; without a declaration that factor is left
out; without labelled documents language and posterior are null; ties go to the
alphabetically first language; repeated pages count as often as they occur and
each give a row; documents with null text or language are not used; very long
pages take time in proportion to their length, also with tags left open.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import ascii_lower, frugal, stage

BUCKETS = 1 << 14

_OPENS = re.compile(r"<!--|<(script|style)\b", re.IGNORECASE)
_CLOSES = {
    "": re.compile("-->"),
    "script": re.compile(r"</script\s*+>", re.IGNORECASE),
    "style": re.compile(r"</style\s*+>", re.IGNORECASE),
}
_TAG = re.compile(r"<[^<>]*>")
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*+=\s*+[\"']?\s*+([A-Za-z]{1,8})", re.IGNORECASE)


@dataclass(frozen=True)
class Fusion:
    """``smooth``: count added to every trigram; ``strength``: pseudo-pages of a
    coarser prior; ``added``: soft pages added to each declaration and suffix;
    ``least_share``: smaller soft counts are left out of the sums."""

    smooth: float = 0.5
    strength: float = 5.0
    added: float = 0.5
    least_share: float = 1e-4
    most_languages: int = 400


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, white space collapsed."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8)
    if len(raw) < 3:
        return np.empty(0, np.int64)
    codes = raw.astype(np.uint32)
    mixed = (codes[:-2] << 16 | codes[1:-1] << 8 | codes[2:]) * np.uint32(2654435761)
    return (mixed >> np.uint32(18)).astype(np.int64)


def shown(page: str) -> str:
    """The page without comments, scripts and styles; what is never closed
    stays. Each kind's end is searched only as long as there is one, so the
    time is linear in the page."""
    parts, at, place, open_ended = [], 0, 0, set()
    while found := _OPENS.search(page, place):
        kind, place = (found[1] or "").lower(), found.end()
        if kind in open_ended:
            continue
        closed = _CLOSES[kind].search(page, place)
        if closed is None:
            open_ended.add(kind)
            continue
        parts.append(page[at : found.start()])
        at = place = closed.end()
    return " ".join([*parts, page[at:]])


def visible(page: str | None) -> str:
    """What a reader sees of a page."""
    return html.unescape(_TAG.sub(" ", shown(page))) if page else ""


def declared(page: str | None) -> str | None:
    found = _DECLARED.search(page) if page else None
    return found[1].lower() if found else None


def train(docs: DataFrame, fusion: Fusion, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages and log P(trigram | language), counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if language not in sums:
                    sums[language] = np.zeros(BUCKETS, np.int64)
                sums[language] += np.bincount(trigrams(content), minlength=BUCKETS)
        for language, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(counts[used])],
                names=["lang", "bucket", "n"],
            )

    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language_trigrams")
    names = [r["lang"] for r in counts.select("lang").distinct().orderBy("lang").limit(fusion.most_languages + 1).collect()]
    if len(names) > fusion.most_languages:
        raise ValueError(f"more than {fusion.most_languages} languages; raise most_languages")
    table = np.full((len(names), BUCKETS), fusion.smooth)
    at = {name: i for i, name in enumerate(names)}
    for row in counts.toLocalIterator():  # at most languages x buckets
        table[at[row["lang"]], row["bucket"]] += row["n"]
    return names, (np.log(table) - np.log(table.sum(1, keepdims=True))).astype(np.float32) if names else table


def text_evidence(languages: list[str], table: np.ndarray):
    """declared, and the tempered log-likelihood per language, of a page."""

    @F.pandas_udf("declared string, text array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                found = trigrams(visible(page))
                logs = np.zeros(len(languages))
                if len(found):
                    used, times = np.unique(found, return_counts=True)
                    logs = table[:, used].astype(np.float64) @ times / math.sqrt(len(found))
                rows.append((declared(page), logs - logs.max() if len(logs) else logs))
            yield pd.DataFrame(rows, columns=["declared", "text"])

    return evidence


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = F.regexp_extract(F.when(at > 0, F.substr(url, at + 3)).otherwise(""), r"^([^/?#:]*+)", 1)
    return ascii_lower(F.coalesce(host, F.lit("")))


def softmax(logs: Column) -> Column:
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def soft_counts(shares: DataFrame, key: str) -> DataFrame:
    """Per key the soft pages of each language, as a sparse map."""
    sums = shares.groupBy(key, "lang").agg(F.sum("share").alias("n"))
    return sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias(f"of_{key}"))


def identify(
    pages: DataFrame,
    docs: DataFrame,
    fusion: Fusion = Fusion(),
    key: str = "page_id",
    url: str = "url",
    page: str = "html",
) -> DataFrame:
    """``key`` with the most likely language, its posterior and the evidence."""
    frugal(pages.sparkSession)
    languages, table = train(docs, fusion)
    narrow = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), F.col(page).alias("page"))
    if not languages:
        return narrow.select(
            F.col("key").alias(key), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"),
            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"), "host",
        )
    judged = narrow.select("key", "host", text_evidence(languages, table)("page").alias("e")).select("key", "host", "e.*")
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    first = stage(
        judged.select(
            "*",
            F.when(domain == "", F.col("host")).otherwise(domain).alias("domain"),
            F.element_at(F.split("host", r"\."), -1).alias("suffix"),
            softmax(F.col("text")).alias("share"),
        ),
        "language_first",
    )
    names = F.array(*[F.lit(x) for x in languages])
    shares = first.select("host", "domain", "suffix", "declared", F.inline(F.arrays_zip(names.alias("lang"), F.col("share").alias("share"))))
    shares = shares.filter(F.col("share") >= fusion.least_share)
    everything = {r["lang"]: r["n"] for r in shares.groupBy("lang").agg(F.sum("share").alias("n")).collect()}
    total = sum(everything.values())
    tables = {k: stage(soft_counts(shares.filter(F.col(k).isNotNull()), k), f"language_{k}") for k in ("host", "domain", "suffix", "declared")}
    kinds = {k: tables[k].count() for k in ("suffix", "declared")}
    spoke = shares.filter("declared is not null").groupBy("lang").agg(F.sum("share").alias("n"))
    declaring = {r["lang"]: r["n"] for r in spoke.collect()}

    joined = first
    for k, counts in tables.items():
        joined = joined.join(counts, k, "left")

    def held(column: str, lang: str) -> Column:
        return F.coalesce(F.get(F.map_values(F.map_filter(column, lambda x, _: x == lang)), 0), F.lit(0.0))

    def size(column: str) -> Column:
        return F.coalesce(F.aggregate(F.map_values(column), F.lit(0.0), lambda a, b: a + b), F.lit(0.0))

    scores = []
    for i, lang in enumerate(languages):
        own = F.get("share", i)
        own = F.when(own >= fusion.least_share, own).otherwise(0.0)  # as far as it is in the sums
        mine = F.aggregate(F.filter("share", lambda x: x >= fusion.least_share), F.lit(0.0), lambda a, b: a + b)
        base = F.lit((everything.get(lang, 0.0) + 1e-6) / (total + 1e-6 * len(languages)))
        prior = base
        for k in ("domain", "host"):
            rest = F.greatest(held(f"of_{k}", lang) - own, F.lit(0.0))
            prior = (rest + fusion.strength * prior) / (F.greatest(size(f"of_{k}") - mine, F.lit(0.0)) + fusion.strength)
        in_suffix = F.greatest(held("of_suffix", lang) - own, F.lit(0.0)) + fusion.added
        suffix = in_suffix / F.greatest(F.lit(everything.get(lang, 0.0)) - own + fusion.added * (kinds["suffix"] + 1), F.lit(fusion.added))
        said = F.greatest(held("of_declared", lang) - own, F.lit(0.0)) + fusion.added
        said = said / F.greatest(F.lit(declaring.get(lang, 0.0)) - own + fusion.added * (kinds["declared"] + 1), F.lit(fusion.added))
        scores.append(
            F.get("text", i) + F.log(prior) + F.log(suffix) + F.when(F.col("declared").isNotNull(), F.log(said)).otherwise(0.0)
        )
    fused = joined.withColumn("scores", F.array(*scores)).withColumn("posteriors", softmax(F.col("scores")))

    def best(column: str) -> Column:
        return F.get(names, (F.array_position(column, F.array_max(column)) - 1).cast("int"))

    return fused.select(
        F.col("key").alias(key),
        best("scores").alias("lang"),
        F.array_max("posteriors").alias("posterior"),
        best("text").alias("text_lang"),
        "declared",
        "host",
    )
