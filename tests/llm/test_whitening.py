import numpy as np
import pytest

from lingua_spark.llm import whitening
from lingua_spark.llm.whitening import Spectrum, secular_roots, whiten


def slow(vectors, kept=8):
    """(n, deviation, whitened, explained) by a dense eigendecomposition."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    away = n * x - sums
    v = (away / n).T @ (away / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    with np.errstate(all="ignore"):
        return n, (away.astype(object) ** 2).sum(1), away / n @ u[:, :kept] / np.sqrt(e[:kept]), e[:kept] / e.sum()


def table(spark, vectors, **more):
    rows = [(i, [float(c) for c in v] if v is not None else None) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)


def compare(got, vectors):
    n, deviation, white, explained = slow(vectors)
    kept = white.shape[1]
    rows = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(rows) == n * kept
    mine = np.array([[rows[i, c + 1]["whitened"] for c in range(kept)] for i in range(n)], float)
    sign = np.sign((mine * white).sum(0))
    assert np.abs(mine * sign - white).max() < 1e-9
    assert [rows[i, 1]["deviation"] for i in range(n)] == list(deviation)
    assert np.allclose([rows[0, c + 1]["explained"] for c in range(kept)], explained, rtol=1e-9)
    errors = {r["identity_error"] for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    assert {r["n"] for r in rows.values()} == {n}


@pytest.mark.parametrize("k", [1, 2, 5, 40])
def test_secular_roots(k):
    rng = np.random.default_rng(k)
    d = np.sort(rng.uniform(0, 10, k))
    z = rng.normal(size=k)
    apart = secular_roots(d, z * z)
    roots = d + np.diagonal(apart)
    assert np.allclose(roots, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("kind", ["normal", "copies", "flat", "tiny and huge", "grid"])
@pytest.mark.parametrize("dim, n", [(1, 6), (2, 9), (9, 4), (24, 300)])
def test_updates_keep_the_spectrum(kind, dim, n):
    rng = np.random.default_rng(dim)
    x = np.floor(1000 * rng.normal(size=(n, dim)))
    if kind == "copies":
        x[n // 3 :] = x[0]
    elif kind == "flat":
        x[:, dim // 2 :] = 7
    elif kind == "tiny and huge":
        x *= 10.0 ** rng.integers(-3, 6, dim)
    elif kind == "grid":
        x = np.round(x / 1000)
    one, two = Spectrum(dim), Spectrum(dim)
    for row in x[: n // 3]:
        one.add(row)
    for row in x[n // 3 :]:
        two.add(row)
    one.combine(Spectrum.unpack(two.pack(), dim))
    away = x - x.mean(0)
    scatter = away.T @ away
    size = max(np.abs(scatter).max(), 1)
    assert one.count == n and np.allclose(one.mean, x.mean(0))
    assert np.abs(one.vectors @ np.diag(one.values) @ one.vectors.T - scatter).max() < 1e-11 * size
    assert np.abs(one.vectors.T @ one.vectors - np.eye(dim)).max() < 1e-11


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    assert sorted(vectors) == list(range(len(vectors)))
    compare(whiten(df), [vectors[i] for i in range(len(vectors))])


def test_many_partitions_are_combined_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    vectors = np.random.default_rng(3).normal(size=(60, 5)).round(3).astype(np.float32)
    compare(whiten(table(spark, vectors).repartition(9)), vectors.astype(float))


def test_odd_rows(spark):
    good = [[1.0, 2.0, 0.5], [0.0, -1.0, 2.0], [3.0, 3.0, 3.0], [1.0, 2.0, 0.5], [-2.0, 0.25, 1.0]]
    nan, inf = float("nan"), float("inf")
    rows = [(None, good[0], "a", 1), *[(i, v, "b", 2) for i, v in enumerate(good[1:], 1)]]
    bad = [(10, None), (11, []), (12, [1.0, None, 2.0]), (13, [nan, 1.0, 1.0]), (14, [inf, 0.0, 0.0]), (15, [1.0, 2.0])]
    df = spark.createDataFrame(
        rows + [(k, v, None, None) for k, v in bad], "vec_id bigint, embedding array<double>, component string, n int"
    )
    got = whiten(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    assert {r["vec_id"] for r in found} == {None, 1, 2, 3, 4} and len(found) == 15
    _, deviation, white, _ = slow(good)
    assert [r["deviation"] for r in sorted(found, key=lambda r: (r["vec_id"] or 0, r["component"])) if r["component"] == 1] == list(deviation)
    assert max(r["identity_error"] for r in found) < 1e-9


def test_no_variance_and_no_rows(spark):
    flat = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)], "vec_id int, embedding array<double>")
    assert {(r["whitened"], r["deviation"], r["identity_error"]) for r in whiten(flat).collect()} == {(None, 0, None)}
    half = spark.createDataFrame([(i, [float(i), 2.0]) for i in range(4)], "vec_id int, embedding array<double>")
    found = whiten(half).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in found)
    assert whiten(flat.limit(0)).collect() == []
    assert len(whiten(flat.limit(1)).collect()) == 2


def test_large_entries(spark):
    vectors = [[1e30, 1.0], [-1e30, 2.0], [5.0, 3.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id int, embedding array<double>")
    found = whiten(df).collect()
    assert len(found) == 6 and {r["deviation"] for r in found if r["vec_id"] != 2} == {None}
