import numpy as np
import pytest

from changelens.llm import catalog, vectors
from tests.llm.conftest import SF


def brute(rows, threshold=0.9):
    """(n_links, component) by comparing every pair, and union of linked sets."""
    usable = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(usable):
        for j in usable[a + 1 :]:
            x, y = (np.array(rows[k][1], float) / np.abs(rows[k][1]).max() for k in (i, j))
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i], links[j] = links[i] + 1, links[j] + 1
                root[find(i)] = find(j)
    sets = {}
    for i, (k, _) in enumerate(rows):
        sets.setdefault(find(i), []).append(k)
    return sorted(((k, links[i], min(sets[find(i)], key=lambda x: (x is None, x))) for i, (k, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in df.collect()), key=repr)


def test_same_as_all_pairs(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert found(catalog.op1_embedding_near_dedup(spark, SF)) == brute(rows)


@pytest.mark.parametrize("dim", [1, 2, 5, 70])
def test_near_the_threshold_and_in_blocks(spark, dim):
    rng = np.random.default_rng(dim)
    centre = rng.normal(size=(6, dim))
    rows = [(i, (centre[i % 6] + rng.normal(size=dim) * 0.25 * np.linalg.norm(centre[i % 6]) / dim**0.5).tolist()) for i in range(150)]
    rows += [(900 + i, rows[i][1]) for i in range(5)] + [(950, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert found(vectors.near_vectors(df)) == want
    assert found(vectors.near_vectors(df, block=20, bucket=30)) == want  # every bucket in pairs of blocks


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e200, 0.0]), (11, [1e-200, 0.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, id int, keys int")
    assert found(vectors.near_vectors(df)) == brute(rows)
    assert not [r for r in vectors.near_vectors(df).collect() if r["vec_id"] is None and r["kept"]]
    assert vectors.near_vectors(df.where("false")).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    dim, x = 64, rng.normal(size=(400, 64))
    x[200:] = x[:200] + 0.45 * rng.normal(size=(200, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    code = vectors.codes(unit, np.arange(400))
    error = vectors.estimates(code, code, dim) - unit @ unit.T
    off = ~np.eye(400, dtype=bool)
    assert abs(error[off].mean()) < 0.003
    pairs = np.arange(200), np.arange(200, 400)
    assert (np.abs(error[pairs]) < 6 * vectors.margins(code, code, dim, 0.9)[pairs]).all()
    assert vectors.margins(code, code, dim, 0.9).max() * 6 < 0.5  # so that unrelated pairs are dropped without an exact computation


def test_a_pair_at_the_threshold_is_missed_rarely():
    for n in (100, 50_000, 10**9):
        bits, tables = vectors.table_plan(n, 0.9, 1e-4, 256)
        meet = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - meet) ** tables <= 1e-4
