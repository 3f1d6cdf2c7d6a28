import math
import random

import pytest

from lingua_spark.functions.pretok import pretokens
from lingua_spark.functions.significance import kendall_p, spearman_p
from lingua_spark.functions.text import words
from lingua_spark.operators import budget, compare, metrics


def average_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    top = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return top / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def tau_b(x, y):
    c = d = tx = ty = 0
    for i in range(len(x)):
        for j in range(i):
            a, b = x[i] - x[j], y[i] - y[j]
            c += a * b > 0
            d += a * b < 0
            tx += a != 0
            ty += b != 0
    return c, d, (c - d) / math.sqrt(tx * ty)


@pytest.mark.parametrize("n,levels", [(2, 50), (3, 2), (17, 100), (40, 6), (90, 1000)])
def test_correlations_by_brute_force(spark, n, levels):
    rng = random.Random(n)
    x = [float(rng.randrange(levels)) for _ in range(n)]
    y = [0.5 * a + rng.randrange(levels) for a in x]
    x[0], x[1], y[0], y[1] = -1.0, -2.0, -3.0, -1.0
    rows = [("30M", str(i), v) for i, v in enumerate(x)] + [("1B", str(i), v) for i, v in enumerate(y)]
    rows += [("3B", "0", 1.0), ("30M", "lonely", 1.0)]  # one common point: no correlation
    df = spark.createDataFrame(rows, "model_size string, tokenizer_path string, bits_per_byte double")
    got = compare.correlation_summary(df).collect()
    assert [(r["small_model"], r["large_model"]) for r in got] == [("30M", "1B")]
    _, _, tau = tau_b(x, y)
    assert got[0]["spearman_rho"] == pytest.approx(pearson(average_ranks(x), average_ranks(y)))
    assert got[0]["kendall_tau"] == pytest.approx(tau)


def test_published_p_values(spark):
    # Worked examples of public statistics documentation.
    x, y = [1, 2, 3, 4, 5], [5, 6, 7, 8, 7]
    assert spearman_p(0.8207826816681233, 5) == pytest.approx(0.08858700531354381, abs=1e-9)
    x, y = [12, 2, 1, 12, 2], [1, 4, 7, 1, 0]
    rows = [("1M", str(i), float(v)) for i, v in enumerate(x)] + [("2M", str(i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "model_size string, tokenizer_path string, bits_per_byte double")
    got = compare.correlation_summary(df).first()
    assert got["kendall_tau"] == pytest.approx(-0.47140452079103173)
    assert got["kendall_p"] == pytest.approx(0.2827454599327748, abs=1e-9)


def test_exact_kendall_p():
    # Five items in order: 2 of 120 permutations are as extreme.
    assert kendall_p(10, 0, 5, (0, 0, 0), (0, 0, 0)) == pytest.approx(2 / 120)
    assert kendall_p(5, 5, 5, (0, 0, 0), (0, 0, 0)) == 1.0
    assert math.isnan(spearman_p(1.0, 2)) and spearman_p(1.0, 5) == 0.0


def test_size_order(spark):
    sizes = spark.createDataFrame([("30M",), ("1B",), ("100M",), ("300M",)], "model_size string")
    got = [tuple(r) for r in compare.size_pairs(sizes).collect()]
    assert set(got) == {
        ("30M", "100M"), ("30M", "300M"), ("30M", "1B"), ("100M", "300M"), ("100M", "1B"), ("300M", "1B"),
    }
    by_name = {tuple(r) for r in compare.size_pairs(sizes, string_order=True).collect()}
    assert ("1B", "30M") in by_name and ("300M", "30M") in by_name


def test_entropy_and_gini(spark):
    tokens = spark.createDataFrame([(t,) for t in "aabbccdd"], "token string")
    assert metrics.entropy(tokens).first()["entropy"] == pytest.approx(2.0)
    assert metrics.entropy(tokens, renyi=2.0).first()["entropy"] == pytest.approx(2.0)
    even = spark.createDataFrame([(1.0,)] * 4, "cost double")
    assert metrics.gini(even).first()["gini"] == pytest.approx(0.0)
    one = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (1.0,)], "cost double")
    assert metrics.gini(one).first()["gini"] == pytest.approx(0.75)


def test_loss_metrics(spark):
    df = spark.createDataFrame([("m", 10.0, 5, 40), ("m", 20.0, 5, 20)], "model string, nll double, n_tokens long, n_bytes long")
    row = metrics.loss_metrics(df).first()
    assert row["perplexity_per_token"] == pytest.approx(math.exp(3))
    assert row["perplexity_per_byte"] == pytest.approx(math.exp(0.5))
    assert row["bits_per_byte"] == pytest.approx(0.5 / math.log(2))


def test_bigram_of_short_texts(spark):
    train = spark.createDataFrame([("a b a b",), ("a",)], "text string").select(words("text").alias("tokens"))
    held = spark.createDataFrame([(1, "a b"), (2, "z"), (3, "b z")], "k int, text string")
    got = {r["k"]: r["nll"] for r in metrics.bigram_nll(train, held.select("k", words("text").alias("tokens")), "k", k=1.0).collect()}
    assert got == pytest.approx({1: -math.log(3 / 4), 3: -math.log(1 / 3)})


def test_empty_vocabulary_has_unit_fertility(spark):
    vocab = spark.createDataFrame([("<s>",), ("",)], "token string")
    special = spark.createDataFrame([("<s>",)], "token string")
    assert tuple(metrics.vocab_fertility(vocab, special).first()) == (1.0, 1.0)


def test_texts_without_words_have_no_mean(spark):
    df = spark.createDataFrame([("a", " "), ("a", "x, y")], "lang string, text string")
    costs = metrics.text_costs(df, pretokens("text", "whitespace"), ("lang",))
    row = metrics.fertility(costs).filter("lang = 'a'").first()
    assert (row["tokens"], row["words"], row["fertility"], row["mean_per_text"]) == (3, 2, 1.5, 1.5)


def test_parameter_counts():
    assert budget.parameters("8B", 131072) / 1e9 == pytest.approx(8.05, abs=0.01)
    assert budget.parameters("3B", 131072, embeddings=False) / 1e9 == pytest.approx(3.22, abs=0.01)
    assert budget.parameters("1B", 131072, embeddings=False) / 1e9 == pytest.approx(1.24, abs=0.01)


def test_token_budget(spark):
    df = spark.createDataFrame([("t", 1000, 10**9)], "tokenizer string, vocab_size long, corpus_tokens long")
    rows = {r["model_size"]: r for r in budget.token_budget(df, warmup_ratio=0.1).collect()}
    r = rows["30M"]
    assert r["params"] == budget.parameters("30M", 1000)
    assert r["target_tokens"] == 20 * r["params"]
    assert r["max_steps"] == r["target_tokens"] // 262144
    assert r["warmup_steps"] == int(r["max_steps"] * 0.1)
    assert r["epochs"] == pytest.approx(r["target_tokens"] / 1e9)
