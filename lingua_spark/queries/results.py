"""Metrics, results and rank correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingua_spark.functions.pretok import SPECIAL_TOKENS, pretokens
from lingua_spark.functions.text import word_count, words
from lingua_spark.learn.parity import lang_compression as compression_by_lang
from lingua_spark.learn.wordtable import word_counts
from lingua_spark.operators import budget, compare, metrics
from lingua_spark.operators.matching import enrich
from lingua_spark.plans.fairness import fairness_report
from lingua_spark.queries.registry import query, table, values
from lingua_spark.queries.texts import WORD_OR_MARKS

WORDS = r"regexp_extract_all(text, '\S+')"
TOKENS = f"regexp_extract_all(text, '{WORD_OR_MARKS}')"
COSTS = f"""
    SELECT doc_id, lang, len({TOKENS}) AS n_tokens, len({WORDS}) AS n_words,
           strlen(text) AS n_bytes, length(text) AS n_chars FROM documents
"""


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _costs(spark, folder, by=("lang",)):
    return metrics.text_costs(table(spark, folder, "documents"), pretokens("text", "whitespace"), by)


@query(
    "fertility",
    f"""
    SELECT coalesce(lang, 'TOTAL') AS lang, sum(n_tokens)::BIGINT AS tokens, sum(n_words)::BIGINT AS words,
           round(sum(n_tokens) / sum(n_words)::DOUBLE, 6) AS fertility,
           round(avg(n_tokens / nullif(n_words, 0)::DOUBLE), 6) AS mean_per_text
    FROM ({COSTS}) GROUP BY ROLLUP (lang)
    """,
)
def fertility(spark, folder):
    return rounded(metrics.fertility(_costs(spark, folder)), "fertility", "mean_per_text")


@query(
    "compression_ratio",
    f"""
    SELECT coalesce(lang, 'TOTAL') AS lang, sum(n_bytes)::BIGINT AS size, sum(n_tokens)::BIGINT AS tokens,
           round(sum(n_bytes) / sum(n_tokens)::DOUBLE, 6) AS compression_ratio,
           round(avg(n_bytes / nullif(n_tokens, 0)::DOUBLE), 6) AS mean_per_text
    FROM ({COSTS}) GROUP BY ROLLUP (lang)
    """,
)
def compression_ratio(spark, folder):
    return rounded(metrics.compression(_costs(spark, folder)), "compression_ratio", "mean_per_text")


@query(
    "compression_ratio_chars",
    f"""
    SELECT coalesce(lang, 'TOTAL') AS lang, sum(n_chars)::BIGINT AS size, sum(n_tokens)::BIGINT AS tokens,
           round(sum(n_chars) / sum(n_tokens)::DOUBLE, 6) AS compression_ratio,
           round(avg(n_chars / nullif(n_tokens, 0)::DOUBLE), 6) AS mean_per_text
    FROM ({COSTS}) GROUP BY ROLLUP (lang)
    """,
)
def compression_ratio_chars(spark, folder):
    return rounded(metrics.compression(_costs(spark, folder), unit="chars"), "compression_ratio", "mean_per_text")


def _tokens(spark, folder, *by):
    docs = table(spark, folder, "documents")
    return docs.select(*by, F.explode(pretokens("text", "whitespace")).alias("token"))


@query(
    "vocab_utilization",
    f"""
    WITH t AS (SELECT lang, unnest({TOKENS}) AS token FROM documents)
    SELECT lang, count(DISTINCT token) AS used,
           round(count(DISTINCT token) / (SELECT count(DISTINCT token) FROM t)::DOUBLE, 6) AS utilization
    FROM t GROUP BY lang
    """,
)
def vocab_utilization(spark, folder):
    size = _tokens(spark, folder).distinct().agg(F.count("*")).scalar()
    out = metrics.vocab_utilization(_tokens(spark, folder, "lang"), size, ("lang",))
    return rounded(out, "utilization")


@query(
    "fairness_gini",
    f"""
    WITH c AS (SELECT lang, sum(n_tokens) / sum(n_bytes)::DOUBLE AS cost FROM ({COSTS}) GROUP BY lang),
         r AS (SELECT cost, row_number() OVER (ORDER BY cost) AS i FROM c)
    SELECT count(*) AS languages,
           round(2 * sum(i * cost) / (count(*) * sum(cost)) - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r
    """,
)
def fairness_gini(spark, folder):
    costs = _costs(spark, folder).groupBy("lang").agg((F.sum("n_tokens") / F.sum("n_bytes")).alias("cost"))
    return rounded(metrics.gini(costs), "gini")


@query(
    "token_entropy",
    f"""
    WITH c AS (SELECT lang, token, count(*)::DOUBLE AS n
               FROM (SELECT lang, unnest({TOKENS}) AS token FROM documents) GROUP BY lang, token),
         s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS p FROM c)
    SELECT lang, count(*) AS types, sum(n)::BIGINT AS tokens, round(-sum(p * log2(p)), 6) AS entropy
    FROM s GROUP BY lang
    """,
)
def token_entropy(spark, folder):
    return rounded(metrics.entropy(_tokens(spark, folder, "lang"), ("lang",)), "entropy")


@query(
    "token_entropy_renyi",
    f"""
    WITH c AS (SELECT token, count(*)::DOUBLE AS n
               FROM (SELECT unnest({TOKENS}) AS token FROM documents) GROUP BY token),
         s AS (SELECT *, n / sum(n) OVER () AS p FROM c)
    SELECT count(*) AS types, sum(n)::BIGINT AS tokens, round(log2(sum(pow(p, 2.5))) / -1.5, 6) AS entropy FROM s
    """,
)
def token_entropy_renyi(spark, folder):
    return rounded(metrics.entropy(_tokens(spark, folder), renyi=2.5), "entropy")


@query(
    "fairness_report",
    f"""
    WITH t(tokenizer, lang, tokens, words, bytes) AS (
             SELECT 'whitespace', lang, len({TOKENS}), len({WORDS}), strlen(text) FROM documents UNION ALL
             SELECT 'words', lang, len({WORDS}), len({WORDS}), strlen(text) FROM documents UNION ALL
             SELECT 'chars', lang, length(text), len({WORDS}), strlen(text) FROM documents),
         s AS (SELECT tokenizer, coalesce(lang, 'TOTAL') AS language, sum(tokens)::DOUBLE AS tokens,
                      sum(words)::DOUBLE AS words, sum(bytes)::DOUBLE AS bytes
               FROM t GROUP BY GROUPING SETS ((tokenizer), (tokenizer, lang))),
         c AS (SELECT tokenizer, tokens / bytes AS cost,
                      row_number() OVER (PARTITION BY tokenizer ORDER BY tokens / bytes) AS i
               FROM s WHERE language <> 'TOTAL')
    SELECT 'fertility' AS metric, tokenizer, language, round(tokens / words, 6) AS value FROM s UNION ALL
    SELECT 'compression_ratio', tokenizer, language, round(bytes / tokens, 6) FROM s UNION ALL
    SELECT 'fairness_gini', tokenizer, 'TOTAL',
           round(2 * sum(i * cost) / (count(*) * sum(cost)) - (count(*) + 1) / count(*)::DOUBLE, 6)
    FROM c GROUP BY tokenizer
    """,
)
def fairness(spark, folder):
    tokenizers = {
        "whitespace": pretokens("text", "whitespace"),
        "words": words("text"),
        "chars": F.split("text", ""),
    }
    return fairness_report(table(spark, folder, "documents"), tokenizers)


def _losses(spark, folder):
    """Stand-in losses: the source is the model, sizes give the loss."""
    return table(spark, folder, "documents").select(
        F.col("source").alias("model"),
        "lang",
        "doc_id",
        (F.length("text") * 0.7 + F.col("doc_id") * 0.01).alias("nll"),
        word_count("text").alias("n_tokens"),
        F.octet_length("text").cast("bigint").alias("n_bytes"),
    )


_LOSSES_SQL = f"""
    SELECT source AS model, lang, doc_id, length(text) * 0.7::DOUBLE + doc_id * 0.01::DOUBLE AS nll,
           len({WORDS}) AS n_tokens, strlen(text) AS n_bytes FROM documents
"""


@query(
    "loss_metrics",
    f"""
    SELECT model, coalesce(lang, 'TOTAL') AS lang, count(*) AS num_examples,
           round(exp(sum(nll) / sum(n_bytes)), 6) AS perplexity_per_byte,
           round(sum(nll) / sum(n_bytes) / ln(2), 6) AS bits_per_byte,
           round(exp(sum(nll) / sum(n_tokens)), 4) AS perplexity_per_token
    FROM ({_LOSSES_SQL}) GROUP BY GROUPING SETS ((model), (model, lang))
    """,
)
def loss_metrics(spark, folder):
    out = metrics.loss_metrics(_losses(spark, folder), extra="lang")
    return rounded(rounded(out, "perplexity_per_byte", "bits_per_byte"), "perplexity_per_token", digits=4)


@query(
    "bigram_nll",
    f"""
    WITH p AS (SELECT w[i] AS prev, w[i + 1] AS cur, count(*) AS n
               FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT {WORDS} AS w FROM documents))
               GROUP BY prev, cur),
         u AS (SELECT prev, sum(n) AS n_prev FROM p GROUP BY prev),
         v AS (SELECT count(DISTINCT t) AS v FROM (SELECT unnest({WORDS}) AS t FROM documents)),
         h AS (SELECT item_id, w[i] AS prev, w[i + 1] AS cur
               FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM (SELECT item_id, {WORDS} AS w FROM benchmark)))
    SELECT item_id, round(sum(-ln((coalesce(n, 0) + 0.1::DOUBLE) / (coalesce(n_prev, 0) + 0.1::DOUBLE * v))), 6) AS nll,
           count(*) AS n_tokens
    FROM h LEFT JOIN p ON p.prev = h.prev AND p.cur = h.cur LEFT JOIN u ON u.prev = h.prev, v GROUP BY item_id
    """,
)
def bigram_nll(spark, folder):
    train = table(spark, folder, "documents").select(words("text").alias("tokens"))
    held_out = table(spark, folder, "benchmark").select("item_id", words("text").alias("tokens"))
    return rounded(metrics.bigram_nll(train, held_out, "item_id"), "nll")


@query(
    "clipped_ppl",
    f"""
    SELECT model, round(exp(least(loss, 20)), 4) AS ppl, round(exp(least(loss / 5.5::DOUBLE, 20)), 6) AS char_ppl,
           round(exp(least(loss / 6.25::DOUBLE, 20)), 6) AS byte_ppl
    FROM (SELECT model, sum(nll) / sum(n_tokens) * CASE WHEN model < 'src11' THEN 1 ELSE 10 END AS loss
          FROM ({_LOSSES_SQL}) GROUP BY model)
    """,
)
def clipped_ppl(spark, folder):
    loss = F.sum("nll") / F.sum("n_tokens")
    per_model = _losses(spark, folder).groupBy("model").agg(loss.alias("loss"))
    scaled = F.col("loss") * F.when(F.col("model") < "src11", 1).otherwise(10)
    out = per_model.select("model", *metrics.clipped_perplexities(scaled, F.lit(5.5), F.lit(6.25)))
    return rounded(rounded(out, "char_ppl", "byte_ppl"), "ppl", digits=4)


@query(
    "score_hook",
    """
    SELECT 'length' AS model, doc_id, length(text) * 0.5::DOUBLE AS nll, length(text) AS n_tokens,
           strlen(text)::BIGINT AS n_bytes FROM documents
    """,
)
def score_hook(spark, folder):
    import pandas as pd

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["text"].str.len()
        size = frame["text"].map(lambda t: len(t.encode("utf-8")))
        return pd.DataFrame({"model": "length", "doc_id": frame["doc_id"], "nll": n * 0.5, "n_tokens": n, "n_bytes": size})

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return metrics.score_texts(docs, score, "model string, doc_id bigint, nll double, n_tokens bigint, n_bytes bigint")


@query(
    "vocab_fertility",
    r"""
    SELECT round(avg(length(token)), 6) AS chars_per_token, round(avg(strlen(token)), 6) AS bytes_per_token
    FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\S+')) AS token FROM documents)
    WHERE token NOT IN ('<pad>', '<s>', '</s>', '<unk>', '<mask>', 'the', 'le')
    """,
)
def vocab_fertility(spark, folder):
    vocab = word_counts(table(spark, folder, "documents"), preset="words").select(F.col("word").alias("token"))
    special = spark.createDataFrame([(t,) for t in [*SPECIAL_TOKENS, "the", "le"]], "token string")
    return rounded(metrics.vocab_fertility(vocab, special), "chars_per_token", "bytes_per_token")


@query(
    "lang_compression",
    f"""
    SELECT lang, sum(strlen(text))::BIGINT AS units, sum(len({TOKENS}))::BIGINT AS tokens,
           round(sum(strlen(text)) / sum(len({TOKENS}))::DOUBLE, 6) AS compression
    FROM documents GROUP BY lang
    """,
)
def lang_compression(spark, folder):
    docs = table(spark, folder, "documents")
    return rounded(compression_by_lang(docs, pretokens("text", "whitespace")), "compression")


@query(
    "enrich_results",
    """
    SELECT l.model_path, coalesce(o.seed, l.seed) AS seed, l.bits_per_byte, o.total_tokens
    FROM (SELECT l_orderkey AS model_path, min(l_linenumber)::BIGINT AS seed,
                 max(l_extendedprice) AS bits_per_byte FROM lineitem GROUP BY l_orderkey) l
    LEFT JOIN (SELECT o_orderkey AS model_path, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS seed,
                      o_totalprice AS total_tokens FROM orders WHERE o_orderstatus <> 'P') o
    ON o.model_path = l.model_path
    """,
)
def enrich_results(spark, folder):
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    results = lines.groupBy(F.col("l_orderkey").alias("model_path")).agg(
        F.min("l_linenumber").cast("bigint").alias("seed"), F.max("l_extendedprice").alias("bits_per_byte")
    )
    info = orders.filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("model_path"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("seed"),
        F.col("o_totalprice").alias("total_tokens"),
    )
    return enrich(results, info, "model_path")


# Line items as a result table: return flag = size, supplier = tokenizer,
# line number = seed, price = metric.
_MEANS = """
    SELECT l_returnflag AS model_size, l_suppkey AS tokenizer_path, avg(l_extendedprice) AS metric_mean
    FROM lineitem GROUP BY l_returnflag, l_suppkey
"""
_MERGED = f"""
    m AS ({_MEANS}),
    g AS (SELECT a.tokenizer_path, a.model_size AS small_model, b.model_size AS large_model,
                 a.metric_mean AS metric_small, b.metric_mean AS metric_large
          FROM m a JOIN m b ON a.tokenizer_path = b.tokenizer_path AND a.model_size < b.model_size)
"""


def _means(spark, folder):
    return compare.seed_means(table(spark, folder, "lineitem"), "l_returnflag", "l_suppkey", "l_extendedprice")


@query("seed_mean", f"SELECT model_size, tokenizer_path, round(metric_mean, 6) AS metric_mean FROM ({_MEANS})")
def seed_mean(spark, folder):
    return rounded(_means(spark, folder), "metric_mean")


@query(
    "merge_sizes",
    f"""
    WITH {_MERGED} SELECT tokenizer_path, small_model, large_model, round(metric_small, 6) AS metric_small,
    round(metric_large, 6) AS metric_large FROM g
    """,
)
def merge_sizes(spark, folder):
    return rounded(compare.merge_sizes(_means(spark, folder)), "metric_small", "metric_large")


@query(
    "size_pairs",
    """
    WITH s AS (SELECT DISTINCT o_orderpriority AS s FROM orders)
    SELECT a.s AS small_model, b.s AS large_model FROM s a JOIN s b ON a.s < b.s
    """,
)
def size_pairs(spark, folder):
    return compare.size_pairs(table(spark, folder, "orders"), "o_orderpriority")


@query(
    "size_pairs_numeric",
    """
    WITH s AS (SELECT DISTINCT p_size AS s FROM part)
    SELECT a.s || 'M' AS small_model, b.s || 'M' AS large_model FROM s a JOIN s b ON a.s < b.s
    """,
)
def size_pairs_numeric(spark, folder):
    # Names like 9M and 10M, whose string order is not their size order.
    sizes = table(spark, folder, "part").select(F.concat(F.col("p_size").cast("string"), F.lit("M")).alias("model_size"))
    return compare.size_pairs(sizes)


@query(
    "metric_range",
    """
    SELECT min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
           min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity FROM lineitem
    """,
)
def metric_range(spark, folder):
    return compare.metric_range(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])


# Average ranks of ties, then Pearson.
_RHO = """
    r AS (SELECT small_model, large_model,
                 rank() OVER x + (count(*) OVER tx - 1) / 2.0 AS rx, rank() OVER y + (count(*) OVER ty - 1) / 2.0 AS ry
          FROM g WINDOW x AS (PARTITION BY small_model, large_model ORDER BY metric_small),
                        y AS (PARTITION BY small_model, large_model ORDER BY metric_large),
                        tx AS (PARTITION BY small_model, large_model, metric_small),
                        ty AS (PARTITION BY small_model, large_model, metric_large)),
    rho AS (SELECT small_model, large_model, count(*) AS n, corr(rx, ry) AS spearman_rho
            FROM r GROUP BY small_model, large_model HAVING count(*) >= 2)
"""
_TAU = """
    tau AS (SELECT a.small_model, a.large_model,
                   sum(CASE WHEN s * t > 0 THEN 1 ELSE 0 END)::BIGINT AS concordant,
                   sum(CASE WHEN s * t < 0 THEN 1 ELSE 0 END)::BIGINT AS discordant,
                   sum(s * t) / (sqrt(sum(abs(s))::DOUBLE) * sqrt(sum(abs(t))::DOUBLE)) AS kendall_tau
            FROM (SELECT a.small_model, a.large_model, sign(a.metric_small - b.metric_small) AS s,
                         sign(a.metric_large - b.metric_large) AS t
                  FROM g a JOIN g b ON a.small_model = b.small_model AND a.large_model = b.large_model
                                   AND a.tokenizer_path < b.tokenizer_path) a
            GROUP BY a.small_model, a.large_model)
"""


@query(
    "spearman",
    f"WITH {_MERGED}, {_RHO} SELECT small_model, large_model, n, round(spearman_rho, 6) AS spearman_rho FROM rho",
)
def spearman(spark, folder):
    return rounded(compare.spearman(compare.merge_sizes(_means(spark, folder)), p_value=False), "spearman_rho")


@query(
    "kendall",
    f"""
    WITH {_MERGED}, {_RHO}, {_TAU}
    SELECT rho.small_model, rho.large_model, n, concordant, discordant, round(kendall_tau, 6) AS kendall_tau
    FROM rho JOIN tau ON rho.small_model = tau.small_model AND rho.large_model = tau.large_model
    """,
)
def kendall(spark, folder):
    return rounded(compare.kendall(compare.merge_sizes(_means(spark, folder)), p_value=False), "kendall_tau")


_TIED = """
    g AS (SELECT a.l_suppkey AS tokenizer_path, a.l_returnflag AS small_model, b.l_returnflag AS large_model,
                 a.q AS metric_small, b.q AS metric_large
          FROM (SELECT l_returnflag, l_suppkey, floor(avg(l_quantity)) AS q FROM lineitem GROUP BY ALL) a
          JOIN (SELECT l_returnflag, l_suppkey, floor(avg(l_quantity)) AS q FROM lineitem GROUP BY ALL) b
          ON a.l_suppkey = b.l_suppkey AND a.l_returnflag < b.l_returnflag)
"""


@query(
    "correlation_with_ties",
    f"""
    WITH {_TIED}, {_RHO}, {_TAU}
    SELECT rho.small_model, rho.large_model, round(spearman_rho, 6) AS spearman_rho,
           round(kendall_tau, 6) AS kendall_tau, 'quantity' AS metric
    FROM rho JOIN tau ON rho.small_model = tau.small_model AND rho.large_model = tau.large_model
    """,
)
def correlation_with_ties(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_returnflag", "l_suppkey")
    means = lines.agg(F.floor(F.avg("l_quantity")).cast("double").alias("quantity"))
    out = compare.correlation_summary(means, "quantity", "l_returnflag", "l_suppkey", p_value=False)
    return rounded(out, "spearman_rho", "kendall_tau")


@query(
    "correlation_summary",
    f"""
    WITH {_MERGED}, {_RHO}, {_TAU}
    SELECT rho.small_model, rho.large_model, round(spearman_rho, 6) AS spearman_rho,
           round(kendall_tau, 6) AS kendall_tau, 'l_extendedprice' AS metric
    FROM rho JOIN tau ON rho.small_model = tau.small_model AND rho.large_model = tau.large_model
    """,
)
def correlation_summary(spark, folder):
    out = compare.correlation_summary(
        table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag", "l_suppkey", p_value=False
    )
    return rounded(out, "spearman_rho", "kendall_tau")


@query("correlation_pvalues")
def correlation_pvalues(spark, folder):
    """The summary with its p-values, which SQL has no functions for, written
    as CSV and JSON and read back."""
    from lingua_spark.runtime import scratch_path
    from lingua_spark.sources.sinks import write_summary

    out = compare.correlation_summary(table(spark, folder, "lineitem"), "l_extendedprice", "l_returnflag", "l_suppkey")
    path = scratch_path(spark, "summary")
    write_summary(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(f"{path}/csv")


_SIZES_SQL = values([(n, budget.fixed_parameters(*c), c[0]) for n, c in budget.MODEL_SIZES.items()])


@query(
    "token_budget",
    f"""
    WITH t(tokenizer, token) AS (
             SELECT 'whitespace', unnest({TOKENS}) FROM documents UNION ALL SELECT 'words', unnest({WORDS}) FROM documents),
         c AS (SELECT tokenizer, count(DISTINCT token) AS vocab_size, count(*) AS corpus_tokens FROM t GROUP BY tokenizer),
         s(model_size, fixed, hidden) AS (VALUES {_SIZES_SQL}),
         p AS (SELECT tokenizer, vocab_size, corpus_tokens, model_size, (fixed + 2 * vocab_size * hidden)::BIGINT AS params
               FROM c, s)
    SELECT *, params * 20 AS target_tokens, params * 20 // 262144 AS max_steps,
           floor((params * 20 // 262144) * 0.01::DOUBLE)::BIGINT AS warmup_steps,
           round(params * 20 / corpus_tokens::DOUBLE, 4) AS epochs, unnest([1, 2]) AS seed
    FROM p
    """,
)
def token_budget(spark, folder):
    docs = table(spark, folder, "documents")
    counts = None
    for name in ("whitespace", "words"):
        # Token counts per type first: hot tokens meet in the map tasks.
        per_type = word_counts(docs, preset=name)
        part = per_type.agg(F.count("*").alias("vocab_size"), F.sum("freq").alias("corpus_tokens"))
        part = part.select(F.lit(name).alias("tokenizer"), "vocab_size", "corpus_tokens")
        counts = part if counts is None else counts.unionByName(part)
    return rounded(budget.token_budget(counts, seeds=(1, 2)), "epochs", digits=4)
