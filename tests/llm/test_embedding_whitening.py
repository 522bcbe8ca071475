"""Whitening against NumPy's eigenvectors and exact whole-number arithmetic."""

import math

import numpy as np
import pytest

from quarry.llm import embedding_whitening as W
from quarry.llm.queries import QUERIES

from tests.conftest import SF_SMALL

SCHEMA = "vec_id long, embedding array<float>, n string, x int"


def frame(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], "clash", 7) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def whole(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]


def check(out, vectors, ids, k):
    x = whole(vectors)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    xc = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    cov = xc.T @ xc / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    assert len(out) == n * k and set(out.n) == {n}
    by_id = {i: g.sort_values("component") for i, g in out.groupby("vec_id")}
    assert sorted(by_id) == sorted(ids)
    got = np.array([by_id[i].whitened.to_numpy() for i in ids])
    assert np.allclose(got.T @ got / n, np.eye(k), atol=1e-9)
    for row, i in zip(x, ids):
        assert set(by_id[i].deviation) == {sum((n * c - s) ** 2 for c, s in zip(row, sums))}
        assert by_id[i].component.tolist() == list(range(1, k + 1))
        assert np.allclose(by_id[i].explained, e[:k] / np.trace(cov), rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-9
    return got, xc, e, v


def test_against_eigenvectors(spark):
    vectors = np.random.default_rng(1).standard_normal((300, 12)) * np.linspace(3, 0.3, 12)
    vectors = vectors.astype(np.float32)
    out = W.whiten(frame(spark, vectors)).toPandas()
    got, xc, e, v = check(out, vectors, range(300), 8)
    want = (xc @ v[:, :8]) / np.sqrt(e[:8])
    assert np.allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-9)


def test_registered_query_on_the_whole_table(spark):
    out = QUERIES["op13_embedding_whitening"](spark, SF_SMALL).toPandas()
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas().sort_values("vec_id")
    check(out, table.embedding.tolist(), table.vec_id.tolist(), 8)


def test_partitions_change_nothing_but_the_last_bits(spark):
    vectors = np.random.default_rng(2).standard_normal((200, 6)).astype(np.float32)
    a, b = (W.whiten(frame(spark, vectors, p)).toPandas().sort_values(["vec_id", "component"]).whitened.to_numpy() for p in (1, 7))
    assert np.allclose(a, b, atol=1e-10)


def test_equal_eigenvalues_are_all_found(spark):
    vectors = [s * 2 * row for row in np.eye(10) for s in (1, -1)]
    out = W.whiten(frame(spark, vectors)).toPandas()
    check(out, vectors, range(20), 8)


def test_fewer_components_where_the_rank_is_lower(spark):
    base = np.random.default_rng(3).integers(-4, 5, (60, 3)).astype(float)
    vectors = np.hstack([base, base, base[:, :1] * 2])
    check(W.whiten(frame(spark, vectors)).toPandas(), vectors, range(60), 3)
    assert W.whiten(frame(spark, [[1.0, 2.0]] * 5)).count() == 0


def test_odd_rows(spark):
    good = np.random.default_rng(4).standard_normal((40, 4)).astype(np.float32).tolist()
    good += [good[0]] * 30  # repeated vectors are rows of their own
    odd = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 1.0, 2.0, 3.0], [-float("inf")] * 4, [1.0, 2.0]]
    out = W.whiten(frame(spark, good + odd)).toPandas()
    check(out, good, range(70), 4)
    nulls = frame(spark, good).selectExpr("cast(null as long) vec_id", "embedding")
    assert W.whiten(nulls).where("vec_id is null").count() == 70 * 4


def test_deviations_beyond_floats(spark):
    vectors = [[2.0 ** 20 * i, -3.0 * i] for i in range(1, 40)]
    out = W.whiten(frame(spark, vectors)).toPandas()
    x = whole(vectors)
    sums = [sum(c) for c in zip(*x)]
    want = [sum((39 * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    got = dict(zip(out.vec_id, out.deviation))
    assert max(want) > 2 ** 62
    for i, w in enumerate(want):
        assert got[i] == w if w < 2 ** 53 else (math.isnan(got[i]) if w >= 2 ** 63 else abs(got[i] - w) <= w * 1e-12)


@pytest.mark.parametrize("rows", [[], [None, []]])
def test_nothing_to_fit(spark, rows):
    out = W.whiten(spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>"))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


def test_bidiagonal_form():
    x = np.random.default_rng(5).standard_normal((50, 9))
    v, b = W.bidiagonalise(lambda p: x.T @ (x @ p), 9)
    assert np.allclose(v.T @ v, np.eye(9)) and np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0)
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x)[1])
    u = (x @ v) @ np.linalg.inv(b)
    assert np.allclose(u.T @ u, np.eye(9), atol=1e-8)
