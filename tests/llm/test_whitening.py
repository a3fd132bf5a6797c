import math

import numpy as np

from changelens.llm import catalog, whitening
from tests.llm.conftest import SF


def plain(vectors):
    """x, exact deviations, eigenvalues and vectors of the covariance, by whole numbers and numpy's own solver."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(col) for col in zip(*x, strict=True)]
    moved = [[n * a - s for a, s in zip(row, sums, strict=True)] for row in x]
    deviations = [sum(a * a for a in row) for row in moved]
    centred = np.array([[a / n for a in row] for row in moved])
    values, components = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviations, values[::-1], components[:, ::-1]


def check(rows, got, components=32):
    centred, deviations, values, vectors = plain([v for _, v in rows])
    kept = min(components, int((values > values[0] * 1e-12).sum()))
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == len(rows) * kept
    for (key, _), deviation, line in zip(rows, deviations, centred, strict=True):
        assert sorted(by_id[key]) == list(range(1, kept + 1))
        for k, r in by_id[key].items():
            assert r["deviation"] == deviation and r["n"] == len(rows)
            assert abs(r["explained"] - values[k - 1] / values.sum()) <= 1e-9 * r["explained"] and r["identity_error"] < 1e-9
            assert abs(abs(r["whitened"]) - abs(line @ vectors[:, k - 1]) / values[k - 1] ** 0.5) < 1e-6
    told = np.array([[by_id[key][k]["whitened"] for k in range(1, kept + 1)] for key, _ in rows])
    assert np.abs(told.T @ told / len(rows) - np.eye(kept)).max() < 1e-9


def test_query(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(rows, catalog.op12_whitening(spark, SF).collect())


def test_few_dimensions_and_unlike_scales(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [1e4, 300, 20, 3, 0.5] + 1000).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    check(rows, whitening.whiten(df).collect())
    check(rows, whitening.whiten(df, components=2).collect(), 2)


def test_dependent_dimensions_have_fewer_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b), float(a + b)]) for i, (a, b) in enumerate(rng.integers(-50, 50, size=(80, 2)))]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1, 2} and len(got) == 160


def test_factor_and_rotation():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 12)) * np.logspace(0, -6, 12)
    c = a.T @ a
    factor, order = whitening.pivoted_cholesky(c)
    assert np.allclose(factor @ factor.T, c[np.ix_(order, order)], rtol=1e-12, atol=1e-12) and np.allclose(np.triu(factor, 1), 0)
    turned = whitening.jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram / np.sqrt(np.outer(gram.diagonal(), gram.diagonal())) - np.eye(12)).max() < 1e-13
    values, vectors = whitening.eigen(c)
    # the smallest of them too, to many digits: singular values of the rows, squared
    assert np.allclose(values, np.linalg.svd(a)[1] ** 2, rtol=1e-6)
    assert np.allclose(vectors.T @ vectors, np.eye(12), atol=1e-12) and np.allclose(vectors @ np.diag(values) @ vectors.T, c, atol=1e-13)
    assert whitening.eigen(np.zeros((3, 3)))[0].size == 0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0]), (2, [1.0, 3.0]), (4, [2.0, -3.0]), (5, [0.0, 0.0]), (5, [0.5, 9.0]), (1, [1.0, 0.0]), (None, [3.0, 3.0])]
    bad = [(6, None), (7, []), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in good + bad], "vec_id long, embedding array<double>, x int, id int, i int")
    got = whitening.whiten(df).collect()
    assert len(got) == 14 and {r["n"] for r in got} == {7}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(k, d) for (k, _), d in zip(good, plain([v for _, v in good])[1], strict=True)}
    assert whitening.whiten(df.where("false")).collect() == [] and whitening.fit(df.where("false")) is None
    assert whitening.whiten(df.where("vec_id = 4")).collect() == []
    huge = spark.createDataFrame([(1, [1e200, 1.0]), (2, [-1e200, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) > 0  # entries held within 2^52


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(10**9, [10**15, 10**15], np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviations(np.array([[10**6, 10**6 + 1]])) == [10**18]
    assert model.deviations(np.array([[10**9, 0]])) == [None]
