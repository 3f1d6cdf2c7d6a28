"""URL filtering by fixed rules and mined association rules, in DataFrames only.

Fixed rules name a host and a path start; they hold for the host and all its
subdomains, and the longest one that fits decides. For the other addresses,
FP-growth mines combinations of URL tokens (host parts and their
words, path parts, file ending, query keys) that go along with a bad label. Rules are kept by
support, a least number of bad pages and confidence, and a rule is dropped if a
part of its tokens already gives a rule at least as sure. Tokens on exactly the
same labelled pages are one item of the mining, met by any of them; that yields
the rules on single tokens at once, and an address repeated on many pages is one
item instead of all subsets of its tokens. They match by an inverted index:
distinct addresses are split into tokens, joined with the rules' rarest items,
and a rule fits if its other items are met, too.

Only distinct addresses and their tokens are shuffled, never pages. The index
is a staged table, so Spark's own size limit decides whether it is broadcast.

Defined cases: a null address, or one without "://", has an empty host and path
and gets ``allow`` from the method; labels of unknown pages, null labels and
null keys train nothing; several labels of a page count as bad if one is;
without labelled pages nothing is mined; repeated pages each give a row; of
equally sure rules the last by name is shown. An address may be long, but time
grows with the number of frequent combinations of items.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingua_spark.llm.common import ascii_lower, stage

BAD = "label=block"
RULES = (
    "rule_id string, items array<string>, any_of array<array<string>>, rarest string, "
    "rarest_tokens array<string>, confidence double, support double"
)

#: The fixed rules of the query: what they say, and host and path start.
FIXED = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@dataclass(frozen=True)
class Mining:
    """Least share and least number of labelled pages that hold a rule's tokens
    and are bad, and least share of bad pages among those that hold its tokens."""

    support: float = 0.01
    confidence: float = 0.8
    pages: int = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*+)([^?#]*+)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*+)([^?#]*+)", 2)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null if none fits."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def tokens(url: Column) -> Column:
    """The distinct tokens of an address; none for an empty one."""
    host, path = host_and_path(url)
    labels = F.filter(F.split(F.regexp_replace(host, r":[0-9]*$", ""), r"\.", -1), lambda x: x != "")
    words = F.filter(F.split(F.array_join(F.filter(labels, lambda x: x.contains("-")), "-"), "-", -1), lambda x: x != "")
    folders = F.filter(F.split(path, "/", -1), lambda x: x != "")
    named = F.transform(
        folders,
        lambda x: F.when(x.rlike(r"^[0-9]+$"), "path=#").otherwise(F.concat(F.lit("path="), F.regexp_replace(ascii_lower(x), "[0-9]+", "#"))),
    )
    query = F.regexp_extract(url, r"\?([^#]*+)", 1)
    keys = F.transform(
        F.filter(F.split(query, "[&;]", -1), lambda x: x != ""),
        lambda x: F.concat(F.lit("query="), F.split_part(x, F.lit("="), F.lit(1))),
    )
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    found = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
        F.transform(words, lambda x: F.concat(F.lit("word="), x)),
        named,
        keys,
        F.when(ending != "", F.array(F.concat(F.lit("ending="), ascii_lower(ending)))).otherwise(F.array()),
    )
    return F.when(F.instr(url, "://") > 0, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules that speak for blocking: rule_id, items, for each item the tokens
    any of which meets it, the rarest item with its tokens, confidence, support.

    ``pages`` has page_id and url, ``labels`` doc_id, quality and toxic: toxic
    pages and those of quality 0 are bad.
    """
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    judged = (
        labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
        .groupBy("doc_id")
        .agg(F.max(bad.cast("int")).alias("bad"))
    )
    labelled = (
        pages.select("page_id", "url")
        .join(judged, F.col("page_id") == F.col("doc_id"))
        .select("bad", tokens(F.col("url")).alias("items"), F.monotonically_increasing_id().alias("row"))
        .filter(F.size("items") > 0)
    )
    labelled = stage(labelled, "url_labelled")
    total = labelled.count()
    least = max(mining.pages, math.ceil(mining.support * total))
    classes = stage(together(labelled, least), "url_tokens")
    baskets = (
        labelled.select("row", "bad", F.explode("items").alias("token"))
        .join(classes, "token")
        .groupBy("row", "bad")
        .agg(F.collect_set("item").alias("items"))
        .select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    )
    baskets = stage(baskets, "url_baskets")
    size = baskets.count()
    if not size:
        return pages.sparkSession.createDataFrame([], RULES)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size, minConfidence=mining.confidence).fit(baskets)
    found = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select(
        F.concat_ws(" ", F.array_sort("antecedent")).alias("rule_id"),
        F.array_sort("antecedent").alias("items"),
        "confidence",
        (F.col("support") * F.lit(size / total)).alias("support"),
    )
    parts = stage(found, "url_found").withColumn("item", F.explode("items"))
    alike = classes.groupBy("item", "n").agg(F.collect_list("token").alias("tokens"))
    rules = (
        parts.join(alike, "item")
        .groupBy("rule_id", "items", "confidence", "support")
        .agg(F.collect_list("tokens").alias("any_of"), F.min_by(F.struct("item", "tokens"), F.struct("n", "item")).alias("first"))
        .select("rule_id", "items", "any_of", F.col("first.item").alias("rarest"), F.col("first.tokens").alias("rarest_tokens"), "confidence", "support")
    )
    return prune(stage(rules, "url_rules"))


def together(labelled: DataFrame, least: int) -> DataFrame:
    """(token, item, n): tokens on at least ``least`` labelled pages, and the
    first of those that are on exactly the same pages, told by two hashes of
    64 bits over these pages."""
    rows = labelled.select("row", F.explode("items").alias("token"))
    pages = rows.groupBy("token").agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("row")).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("other"), F.col("row"))).alias("other"),
    )
    alike = pages.filter(F.col("n") >= least).groupBy("n", "one", "other")
    sets = alike.agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return sets.select(F.explode("tokens").alias("token"), "item", "n")


def prune(rules: DataFrame) -> DataFrame:
    """Rules without those that a rule on some of their items makes needless.

    Each rule is looked up under its rarest item only, so an item that many
    rules hold does not bring all of them together.
    """
    parts = rules.select("rule_id", "items", "confidence", F.explode("items").alias("item"))
    shorter = rules.select(
        F.col("rule_id").alias("short_id"),
        F.col("items").alias("short_items"),
        F.col("confidence").alias("short_confidence"),
        F.col("rarest").alias("item"),
    )
    needless = (
        parts.join(shorter, "item")
        .filter("rule_id <> short_id and short_confidence >= confidence and size(array_except(short_items, items)) = 0")
        .select("rule_id")
        .distinct()
    )
    return rules.join(needless, "rule_id", "left_anti")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct addresses that a rule fits, with the surest one.

    The index holds a rule under the tokens of its rarest item; its other items
    are tested on the address itself.
    """
    index = stage(
        rules.select("rule_id", "confidence", "any_of", F.explode("rarest_tokens").alias("item")),
        "url_index",
    )
    parts = urls.filter("url is not null").select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("item"))
    return (
        parts.join(index, "item")
        .withColumn("held", tokens(F.col("url")))
        .filter(F.forall("any_of", lambda some: F.arrays_overlap(some, F.col("held"))))
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "rule_id")).alias("best"))
        .select("url", F.col("best.rule_id").alias("mined_rule"), F.col("best.confidence").alias("confidence"))
    )


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = FIXED, mining: Mining = Mining()
) -> DataFrame:
    """Every page with host, path, the fixed rule that decides, the mined rule
    that would, and the verdict."""
    narrow = pages.select("page_id", "url")
    hits = stage(matched(narrow, mine(narrow, labels, mining)), "url_matched")
    host, path = host_and_path(F.col("url"))
    judged = narrow.join(hits, "url", "left").select("page_id", host.alias("host"), path.alias("path"), "mined_rule", "confidence")
    rule, says = fixed_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "mined_rule", "confidence")
