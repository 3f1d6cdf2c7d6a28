import math
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lingua_spark.llm.language_id import BUCKETS, Fusion, declared, identify, shown, trigrams, visible

DOCS = [
    (1, "the cat and the dog went to the house with the others", "en"),
    (2, "der hund und die katze gehen zu dem haus mit den anderen", "de"),
    (3, "le chat et le chien vont vers la maison avec les autres", "fr"),
    (4, None, "de"),
    (5, "ohne sprache", None),
]
PAGES = [
    (1, "http://a.site.de/x", "<html lang='de-AT'><script>the the the</script><p>die katze und der hund</p>"),
    (2, "http://a.site.de/y", "<html lang=de><!-- the the --><p>das haus mit den anderen</p>"),
    (2, "http://a.site.de/y", "<html lang=de><!-- the the --><p>das haus mit den anderen</p>"),
    (3, "http://b.site.de/", "<p>haus</p>"),
    (4, "http://news.com/1", '<HTML class="x" LANG="en"><p>the house &amp; the dog with others</p>'),
    (5, "http://news.com/2", "<html lang=en>le chien et la maison avec les autres"),
    (6, None, None),
    (7, "http://news.com/3", ""),
    (None, "nonsense", "le chat vont vers les autres"),
    (8, "HTTP://A.SITE.DE:80/z?q", None),
]


def slow(pages, docs, f=Fusion()):
    """The same sums with plain dictionaries."""
    counts = defaultdict(lambda: [f.smooth] * BUCKETS)
    for _, text, lang in docs:
        if text is not None and lang is not None:
            for t in trigrams(text):
                counts[lang][t] += 1
    langs = sorted(counts)
    rows = []
    for key, url, page in pages:
        found = trigrams(visible(page))
        logs = [sum(math.log(counts[x][t] / sum(counts[x])) for t in found) / math.sqrt(len(found)) if len(found) else 0.0 for x in langs]
        host = url.split("://", 1)[1] if url and "://" in url else ""
        for stop in "/?#:":
            host = host.split(stop)[0]
        host = host.lower()
        top = max(logs)
        power = [math.exp(x - top) for x in logs]
        share = [p / sum(power) for p in power]
        domain = ".".join(host.split(".")[-2:])
        rows.append((key, host, domain, host.split(".")[-1], declared(page), [x - top for x in logs], [s if s >= f.least_share else 0.0 for s in share]))
    sums = [defaultdict(lambda: [0.0] * len(langs)) for _ in range(4)]
    for _, host, domain, suffix, said, _, share in rows:
        for table, k in zip(sums, (host, domain, suffix, said)):
            if k is not None:
                table[k] = [a + b for a, b in zip(table[k], share)]
    every = [sum(r[6][i] for r in rows) for i in range(len(langs))]
    saying = [sum(r[6][i] for r in rows if r[4] is not None) for i in range(len(langs))]
    out = []
    for key, host, domain, suffix, said, logs, share in rows:
        scores = []
        for i in range(len(langs)):
            prior = (every[i] + 1e-6) / (sum(every) + 1e-6 * len(langs))
            for table, k in ((sums[1], domain), (sums[0], host)):
                prior = (table[k][i] - share[i] + f.strength * prior) / (sum(table[k]) - sum(share) + f.strength)
            score = logs[i] + math.log(prior)
            score += math.log((sums[2][suffix][i] - share[i] + f.added) / (every[i] - share[i] + f.added * (len(sums[2]) + 1)))
            if said is not None:
                score += math.log((sums[3][said][i] - share[i] + f.added) / (saying[i] - share[i] + f.added * (len(sums[3]) + 1)))
            scores.append(score)
        power = [math.exp(s - max(scores)) for s in scores]
        out.append((key, langs[scores.index(max(scores))], round(max(power) / sum(power), 6)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def frames(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("share", F.lit(1))
    return pages, spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string")


def test_equals_plain_sums(frames):
    got = identify(*frames).collect()
    assert sorted(((r["page_id"], r["lang"], round(r["posterior"], 6)) for r in got), key=str) == slow(PAGES, DOCS)
    by_id = {r["page_id"]: r for r in got}
    assert by_id[1]["lang"] == "de" and by_id[8]["host"] == "a.site.de" and by_id[8]["lang"] == "de"


def test_empty_tables(frames):
    pages, docs = frames
    assert identify(pages.limit(0), docs).count() == 0
    rows = identify(pages, docs.limit(0)).collect()
    assert len(rows) == len(PAGES) and all(r["lang"] is None for r in rows)


def test_hidden_parts_equal_one_pattern():
    pattern = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.DOTALL | re.IGNORECASE)
    draw = random.Random(4)
    pieces = ["<!--", "-->", "<script", "<SCRIPT>", "</script>", "</Script \n>", "<style>", "</style", ">", "a", "<scripty>", "\n"]
    for _ in range(5000):
        page = "".join(draw.choices(pieces, k=draw.randint(0, 14)))
        assert shown(page) == pattern.sub(" ", page), page


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<style>x", "<html lang=", "<html lang", "<", "</script ", "&#", "<html lang = 'd"])
def test_pages_of_open_tags_take_linear_time(piece):
    start = time.process_time()
    page = piece * (5_000_000 // len(piece))
    visible(page), declared(page), declared("<html lang=" + " " * 5_000_000)
    assert time.process_time() - start < 15


def test_many_languages(spark):
    docs = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{w}" for w in "klmnop"), f"l{i:02d}") for i in range(75)]
    pages = [(i, "http://x.org/", docs[i][1]) for i in (0, 30, 74)] + [(99, "http://x.org/", "")]
    rows = identify(
        spark.createDataFrame(pages, "page_id bigint, url string, html string"),
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string"),
    )
    found = {r["page_id"]: r["lang"] for r in rows.collect()}
    assert {k: found[k] for k in (0, 30, 74)} == {0: "l00", 30: "l30", 74: "l74"} and 99 in found


def test_labelled_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    rows = identify(pages, spark.read.parquet(f"{folder}/documents.parquet"))
    named = pages.select("page_id", F.regexp_extract("url", "://[^/]*/([a-z]+)/", 1).alias("path"))
    assert rows.join(named, "page_id").filter("lang = path").count() >= 0.99 * pages.count()
