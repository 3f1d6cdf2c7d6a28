from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from lingua_spark.llm.url_rules import FIXED, Mining, host_and_path, judge, mine, tokens

URLS = {
    "https://WWW.Example.ORG/es/1?x=1": ("www.example.org", "/es/1", "example.org/es/"),
    "http://example.org/en/17#top": ("example.org", "/en/17", "example.org/en/1"),
    "http://example.org/en/27": ("example.org", "/en/27", "org/"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/"),
    "http://a.com/fr/1": ("a.com", "/fr/1", "com/fr/"),
    "http://com/de/": ("com", "/de/", "com/de/"),
    "http://x.org": ("x.org", "", None),
    "http://ÀB.com?u=http://y.com/fr/": ("Àb.com", "", None),
    "no address": ("", "", None),
    "": ("", "", None),
    None: ("", "", None),
    "a://b://c/d": ("b:", "//c/d", None),
    "://h/p\nq?": ("h", "/p\nq", None),
}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


def test_fixed_rules(spark, labels):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, None, "y")], "page_id bigint, url string, items string")
    rows = {r["page_id"]: r for r in judge(pages, labels).collect()}
    assert len(rows) == len(URLS) + 1
    verdicts = {text: says for says, text in FIXED}
    for i, (host, path, rule) in enumerate(URLS.values()):
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert rows[i]["verdict"] == (verdicts[rule] if rule else "allow")
    assert judge(pages.limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def world(spark):
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        host = ("casino" if bad or i % 8 == 1 else "news") + f"-{i % 5}.net"
        rows.append((i, f"http://{host}/{'win' if bad else 'read'}/{i}.html?{'aff' if bad and i % 8 else 'id'}=1", int(not bad), int(bad and i % 3 == 0)))
    pages = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (900, "http://casino-1.net/win/9"), (900, "http://casino-1.net/win/9")], "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows] + [(5, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    return pages, labels


def slow_rules(baskets, mining):
    found = {}
    universe = {frozenset(c) for items, bad in baskets if bad for n in range(1, len(items) + 1) for c in combinations(sorted(items), n)}
    for some in universe:
        held = [bad for items, bad in baskets if some <= items]
        if sum(held) >= mining.support * len(baskets) and sum(held) >= mining.confidence * len(held):
            found[some] = sum(held) / len(held)
    return {r: c for r, c in found.items() if not any(o < r and found[o] >= c for o in found)}


def test_mined_rules_equal_counting(world):
    pages, labels = world
    mining = Mining(support=0.02, confidence=0.8)
    rows = pages.join(labels, F.col("page_id") == F.col("doc_id")).select(tokens(F.col("url")).alias("t"), "quality", "toxic").filter("quality is not null").collect()
    want = slow_rules([(frozenset(r["t"]), r["toxic"] == 1 or r["quality"] == 0) for r in rows], mining)
    got = {frozenset(c): r["confidence"] for r in mine(pages, labels, mining).collect() for c in product(*r["any_of"])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    judged = judge(pages, labels, mining=mining).collect()
    assert len(judged) == 403
    for row in judged:
        assert row["verdict"] == ("block" if row["path"].startswith("/win/") else "allow"), row


def test_long_address_on_many_pages(spark):
    """Forty tokens on all bad pages are one item; four pages make no rule."""
    long = "http://a-b.example.net/" + "/".join(chr(97 + i % 26) * (1 + i // 26) for i in range(40))
    rows = [(i, long) for i in range(60)] + [(100 + i, f"http://rare.example.com/four/{i}") for i in range(4)]
    rows += [(200 + i, "http://good.example.com/fine") for i in range(60)] + [(900, "http://x.net/aa"), (901, "http://rare.example.com/four/9"), (902, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(r[0], int(r[0] >= 200), 0) for r in rows if r[0] < 900], "doc_id bigint, quality int, toxic int")
    (rule,) = mine(pages, labels).collect()
    assert len(rule["items"]) == 1 and len(rule["any_of"][0]) == len(rule["rarest_tokens"]) > 40
    verdicts = {r["page_id"]: r["verdict"] for r in judge(pages, labels, rules=[]).collect()}
    assert verdicts == {r[0]: "block" if r[0] < 60 or r[0] == 900 else "allow" for r in rows}
    five = mine(pages, labels, Mining(pages=4)).collect()
    assert any("path=four" in tokens for r in five for tokens in r["any_of"])


def test_host_of_a_column(spark):
    host, path = host_and_path(F.lit("http://A.b:80/c;d?e"))
    assert tuple(spark.range(1).select(host, path).first()) == ("a.b:80", "/c;d")
