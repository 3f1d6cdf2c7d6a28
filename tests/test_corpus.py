import bisect
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lingua_spark.operators import corpus, matching, mixing, ordered
from lingua_spark.operators.corpus import SplitOptions
from lingua_spark.plans.corpus_build import corpus_targets
from lingua_spark.sources import languages


def uniform(key, seed=42, purpose="split"):
    return int(hashlib.md5(f"{seed}:{purpose}:{key}".encode()).hexdigest()[:8], 16) / 2**32


def sequential_split(rows, target, o):
    """The rows of one language, one after the other."""
    out, written, counts = {}, 0, {"train": 0, "val": 0, "test": 0}
    if target == 0 and o.min_lines_floor == 0:
        return out
    for key, text in rows:
        size = len(text.encode()) + (0 if text.endswith("\n") else 1)
        over = target > 0 and written + size > target
        if over and counts["train"] >= o.min_lines_floor:
            break
        r = uniform(key)
        if over:
            name = "train"
        elif r < o.val_frac and counts["val"] < o.max_eval_rows:
            name = "val"
        elif r < o.val_frac + o.test_frac and counts["test"] < o.max_eval_rows:
            name = "test"
        else:
            name = "train"
        out[key] = name
        counts[name] += 1
        written += size
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for key in range(400):
        lang = "hot" if key % 3 else rng.choice(["a", "b"])
        out.append((key * 7, lang, "x" * rng.randrange(0, 40) + rng.choice(["", "\n", "é"])))
    out.append((1001, "b", "y" * 3000))  # one huge row in the middle
    return out


@pytest.mark.parametrize(
    "share,options",
    [
        (0.5, SplitOptions(0.1, 0.1, 5, 0)),
        (0.2, SplitOptions(0.1, 0.1, 3, 60)),
        (5.0, SplitOptions(0.3, 0.1, 4, 0)),
        (0.3, SplitOptions(0.0, 0.2, 100, 10)),
        (0.1, SplitOptions(0.2, 0.2, 0, 1000)),
        (0.0, SplitOptions(0.1, 0.1, 5, 20)),
        (0.0, SplitOptions(0.1, 0.1, 5, 0)),
        (0.001, SplitOptions(0.1, 0.1, 5, 3)),
    ],
)
def test_budget_split_equals_a_loop(spark, rows, share, options):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    targets, expected = [], {}
    for lang in ("hot", "a", "b"):
        mine = sorted((k, t) for k, l, t in rows if l == lang)
        target = int(share * sum(len(t.encode()) + 1 for _, t in mine))
        targets.append((lang, target))
        expected |= sequential_split(mine, target, options)
    got = corpus.budget_split(df, spark.createDataFrame(targets, "lang string, target_bytes long"), options)
    assert {r["doc_id"]: r["split"] for r in got.collect()} == expected


def shares(sizes, t, cap):
    powered = {k: v ** (1 / t) for k, v in sizes.items()}
    p = {k: v / sum(powered.values()) for k, v in powered.items()}
    if any(v > cap for v in p.values()):
        p = {k: min(v, cap) for k, v in p.items()}
        left = 1 - sum(v for v in p.values() if v == cap)
        free = sum(powered[k] for k in p if p[k] < cap)
        p = {k: powered[k] / free * left if v < cap else v for k, v in p.items()}
    total = sum(p.values())
    return {k: v / total for k, v in p.items()}


@pytest.mark.parametrize("t,cap", [(1.0, 0.5), (5.0, 0.5), (2.0, 0.2), (1.0, 0.1), (1.0, 1.0)])
@pytest.mark.parametrize("sizes", [{"a": 90.0, "b": 9.0, "c": 1.0}, {"a": 5.0}, {"a": 1.0, "b": 1.0}])
def test_proportions(spark, sizes, t, cap):
    df = spark.createDataFrame(list(sizes.items()), "lang string, size double")
    got = {r["lang"]: r["proportion"] for r in corpus.lang_proportions(df, t, cap).collect()}
    assert got == pytest.approx(shares(sizes, t, cap), abs=1e-9)
    assert sum(got.values()) == pytest.approx(1.0)


def test_targets_of_a_language_set(spark):
    rows = {r["lang"]: r["target_bytes"] for r in corpus_targets(spark, "L20", total_gb=1.0).collect()}
    assert len(rows) == 20 and abs(sum(rows.values()) - 2**30) < 20
    assert max(rows, key=rows.get) == "en"


def test_language_table(spark):
    table = languages.LANGUAGES
    assert len(table) == 75 and len(set(languages.LANG_SETS["L100"])) == 75
    assert {r[0] for r in table} == set(languages.LANG_SETS["L100"])
    assert (len(languages.LANG_SETS["L20"]), len(languages.LANG_SETS["L60"])) == (20, 60)
    assert languages.lang_set_members(" en, xx ,,de") == ["en", "xx", "de"]


def test_blocks_are_a_bisection(spark):
    bounds = [3, 8, 8.5, 20, 21]
    df = spark.createDataFrame([(float(v),) for v in range(-2, 25)], "x double")
    for row in df.select("x", ordered.block_of("x", bounds).alias("b")).collect():
        assert row["b"] == bisect.bisect_right(bounds, row["x"])


def test_running_totals_of_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 10 else "cold", rng.randrange(5)) for i in rng.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "k long, g string, v long").repartition(6)
    bounds = ordered.block_bounds(df, "k", 9)
    assert len(bounds) == 8
    got = ordered.running_total(df, ["g"], "k", "v", "t", bounds).collect()
    totals = {}
    for k, g, v in sorted(rows):
        totals[g] = totals.get(g, 0) + v
        assert next(r["t"] for r in got if r["k"] == k) == totals[g]


def interleaved(sources, every=False):
    """Round robin over lists until the first (or the last) has run dry."""
    out, at, dry = [], [0] * len(sources), [False] * len(sources)
    while True:
        for i, rows in enumerate(sources):
            out.append(rows[at[i]])
            at[i] += 1
            if at[i] == len(rows):
                dry[i], at[i] = True, 0
            if all(dry) if every else any(dry):
                return out


@pytest.mark.parametrize("sizes", [(1, 3, 5), (5, 3, 1), (4, 4), (2, 7, 2, 9)])
def test_interleave(spark, sizes):
    sources = [[100 * s + i for i in range(n)] for s, n in enumerate(sizes)]
    rows = [(k, f"s{s}") for s, ks in enumerate(sources) for k in ks]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for every in (False, True):
        got = mixing.interleave(df, stopping="all_exhausted" if every else "first_exhausted")
        got = [r["doc_id"] for r in got.orderBy("position").collect()]
        assert got == interleaved(sources, every)
    order = interleaved(sources)
    for n in (0, 1, 3, 100):
        parts = {r["doc_id"]: r["part"] for r in mixing.take_skip(df, n).collect()}
        assert parts == {k: "eval" if i < n else "train" for i, k in enumerate(order)}


def test_first_n_per_lang(spark, rows):
    df = spark.createDataFrame(rows + [(2000, None, "z")], "doc_id long, lang string, text string")
    for n in (2, 10, 500):
        head, expected = sorted(rows + [(2000, None, "z")], key=lambda r: r[0])[: 20 * n], {}
        for key, lang, text in head:
            if text.strip() and len(expected.setdefault(lang or "unknown", [])) < n:
                expected[lang or "unknown"].append(key)
        got = {}
        for r in corpus.first_n_per_lang(df, n).orderBy("doc_id").collect():
            got.setdefault(r["lang"], []).append(r["doc_id"])
        assert got == {k: v for k, v in expected.items() if v}


def test_dev_rows_count_blanks(spark):
    rows = [(i, "f", " " if i == 4 else "a b c") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, language string, text string")
    got = corpus.modulo_dev_split(df, every=4, max_chars=3)
    dev = sorted({r["doc_id"] for r in got.filter("split = 'dev'").collect()})
    assert dev == [0, 8]
    assert got.filter("doc_id = 0").count() == 2


def test_sample_hits_its_target(spark):
    rows = [(i, "big" if i % 4 else "small", "x" * 99) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = corpus.tokenizer_sample(df, 100_000 / 2**30, 1.0)
    counts = {r["lang"]: r["count"] for r in got.groupBy("lang").count().collect()}
    assert 600 < counts["big"] < 900 and 180 < counts["small"] < 320
    again = corpus.tokenizer_sample(df.repartition(9), 100_000 / 2**30, 1.0)
    assert sorted(r[0] for r in again.select("doc_id").collect()) == sorted(
        r[0] for r in got.select("doc_id").collect()
    )


def test_blank_language_is_listed(spark):
    rows = [(3, "a", "x"), (1, "b", " "), (2, "a", "")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = [(r["lang"], r["position"], r["samples"]) for r in corpus.lang_order(df).orderBy("position").collect()]
    assert got == [("b", 0, 0), ("a", 1, 1)]


def test_parallel_route_with_open_script(spark):
    targets = matching.parallel_targets(
        spark.createDataFrame([("x", "aaa_Latn"), ("y", "aaa"), ("z", "bbb_Cyrl"), ("w", "")], "lang string, flores_code string")
    )
    rows = spark.createDataFrame(
        [("aaa", "Latn", "1"), ("aaa", "Arab", "2"), ("bbb", "Latn", "3"), ("aaa", "Latn", None)],
        "iso_639_3 string, iso_15924 string, text string",
    )
    got = sorted((r["lang"], r["text"]) for r in matching.parallel_route(rows, targets).collect())
    assert got == [("x", "1"), ("y", "1"), ("y", "2")]


def test_enrich_prefers_present_info(spark):
    results = spark.createDataFrame([(1, 5, 0.5), (2, 6, 0.6)], "k int, seed int, m double")
    info = spark.createDataFrame([(1, None, "x")], "k int, seed int, extra string")
    got = {tuple(r) for r in matching.enrich(results, info, "k").collect()}
    assert got == {(1, 5, 0.5, "x"), (2, 6, 0.6, None)}


def test_result_does_not_depend_on_partitioning(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    targets = spark.createDataFrame([("hot", 2000), ("a", 500)], "lang string, target_bytes long")
    options = SplitOptions(0.1, 0.1, 5, 30)
    runs = [
        sorted(map(tuple, corpus.budget_split(frame, targets, options).select("doc_id", "split").collect()))
        for frame in (df.coalesce(1), df.repartition(11), df.repartition(3, F.col("lang")))
    ]
    assert runs[0] == runs[1] == runs[2]


def test_limits_between_identical_rows(spark):
    """Rows that are equal in every column are still counted one by one."""
    rows = [(i // 3, "en", "ten bytes!") for i in range(12)] + [(None, "en", "ten bytes!")] * 2
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    targets = spark.createDataFrame([("en", 45)], "lang string, target_bytes long")  # four rows of 11 bytes
    out = corpus.budget_split(df, targets, corpus.SplitOptions(0, 0)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["0", "0", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in corpus.first_n_per_lang(df, 4).collect()) == ["0", "0", "None", "None"]
    both = df.withColumn("source", F.lit("a")).unionByName(df.withColumn("source", F.lit("b")))
    parts = mixing.take_skip(both, 9).collect()
    assert sum(r["part"] == "eval" for r in parts) == 9 and len(parts) == 27


def test_identical_rows_are_split_exactly(spark):
    df = spark.createDataFrame([(1, "en", "same")] * 40, "doc_id long, lang string, text string")
    targets = spark.createDataFrame([("en", 5 * 30)], "lang string, target_bytes long")
    out = corpus.budget_split(df, targets, corpus.SplitOptions(1.0, 0.0, 7)).collect()
    counts = {s: sum(r["split"] == s for r in out) for s in ("train", "val", "test")}
    # a full val overflows into test
    assert counts == {"train": 16, "val": 7, "test": 7}


def test_strings_order_rows(spark):
    df = spark.createDataFrame([(c, "en", c) for c in "hgfedcba"], "doc_id string, lang string, text string")
    assert sorted(r["doc_id"] for r in corpus.first_n_per_lang(df, 3).collect()) == ["a", "b", "c"]


def test_sample_is_independent_of_the_split(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'en' as lang", "'some text' as text")
    targets = spark.createDataFrame([("en", 10**9)], "lang string, target_bytes long")
    train = corpus.budget_split(df, targets, corpus.SplitOptions(0.05, 0.05, 10**6)).filter("split = 'train'")
    n = train.count()
    got = corpus.tokenizer_sample(train, 0.02 * n * 10 / 1024**3).count()
    assert abs(got - 0.02 * n) < 5 * (0.02 * n) ** 0.5
