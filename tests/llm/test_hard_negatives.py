import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingua_spark.llm import hard_negatives
from lingua_spark.llm.hard_negatives import Best, Mining, exact, mine
from lingua_spark.llm.queries import OP13_SQL, QUERIES


def slow(rows, anchor, mining=Mining()):
    """Every window answered on its own, over all rows."""
    q = [(k, l, [math.floor(mining.scale * c) for c in v]) for k, l, v in rows]
    out = []
    for i, (key, label, v) in enumerate(q):
        if not anchor(key):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), k, j, m) for j, (k, m, w) in enumerate(q) if j != i)
        for s, k, _, m in [x for x in scored if x[3] == label][: mining.positives]:
            fit = [x for x in scored if x[3] != label and mining.low * -s <= 100 * -x[0] <= mining.high * -s]
            out += [(key, k, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit[: mining.negatives])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


SCHEMA = "vec_id bigint, label int, embedding array<double>"


def some(n, dim, labels, seed, step=0.25):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(size=(n, dim)) / step) * step
    return [(i, int(rng.integers(labels)), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("mining", [Mining(), Mining(positives=1, negatives=1), Mining(positives=7, negatives=3, anchors=3, low=-50, high=120)])
def test_equals_every_window(spark, monkeypatch, mining):
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "BESIDE", 4)
    rows = some(150, 4, 3, 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = rows_of(mine(df, F.col("vec_id") % 10 == 0, mining))
    assert found == slow(rows, lambda k: k % 10 == 0, mining) and found


def test_sql_says_the_same(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert rows_of(QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.01")) == sorted(db.execute(OP13_SQL).fetchall())


def test_odd_rows(spark):
    rows = some(40, 3, 2, 5)
    bad = [
        (100, 0, None),
        (200, None, [1.0, 1.0, 1.0]),
        (300, 1, [1.0, None, 1.0]),
        (400, 1, [float("nan"), 1.0, 1.0]),
        (500, 1, [float("-inf"), 1.0, 1.0]),
        (600, 1, [1.0]),
        (700, 1, []),
        (None, 1, [1.0, 1.0, 1.0]),
    ]
    more = "slot int, score string, anchor int, row bigint"
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows + bad], f"{SCHEMA}, {more}")
    assert rows_of(mine(df, F.col("vec_id") % 4 == 0)) == slow(rows, lambda k: k % 4 == 0)
    assert mine(df.limit(0), F.col("vec_id") % 4 == 0).collect() == []
    assert mine(df, F.col("vec_id") < 0).collect() == []
    assert mine(spark.createDataFrame([rows[0]], SCHEMA), F.lit(True)).collect() == []


def test_ties_and_repeated_rows(spark):
    """One very common vector, keys that repeat, and anchors among them."""
    same = [(i % 60, i % 2, [1.0, 0.5]) for i in range(120)]
    near = [(i, i % 2, [0.5, 0.25]) for i in range(60, 90)]
    df = spark.createDataFrame(same + near, SCHEMA).repartition(3)
    found = rows_of(mine(df, F.col("vec_id") % 20 == 0))
    assert found == slow(same + near, lambda k: k % 20 == 0) and len(found) > 100


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(0, 6)), max_size=60), st.integers(1, 5))
def test_best_keeps_the_first(offers, k):
    best = Best(4, k)
    for at in range(0, len(offers), 7):
        part = [np.array(c, np.int64) for c in zip(*[(*o, at + i) for i, o in enumerate(offers[at : at + 7])])]
        best.offer(*part)
    kept = list(zip(*map(list, best.filled())))
    ranked = sorted((g, -s, i, r) for r, (g, s, i) in enumerate(offers))
    expected = [r for g in range(4) for r in [x for x in ranked if x[0] == g][:k]]
    assert [(g, -s, i, r) for g, s, i, r in kept] == expected


@pytest.mark.parametrize("size", [100, 1 << 20, 1 << 26])
def test_products_are_exact(size):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-size, size, (5, 64)), rng.integers(-size, size, (7, 64))
    assert exact(a, b).tolist() == (a.astype(object) @ b.T.astype(object)).tolist()
