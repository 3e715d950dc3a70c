"""Whitening against numpy's own decomposition of the covariance, and the cases it defines."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from courtlake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, deviation int, one int"


def _frame(spark, vectors, start=0):
    return spark.createDataFrame([(i + start, v, 1, 2, 3, 4) for i, v in enumerate(vectors)], SCHEMA).repartition(5)


def _whole(v):
    return tuple(math.floor(256 * float(c)) for c in v)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(6, 6)) * np.array([3, 1, 1, 0.5, 0.1, 0.02])
    out = [[float(np.float32(c)) for c in v] for v in rng.normal(size=(400, 6)) @ mix.T + 7]
    return out + [list(out[0])] * 150               # copies count once


def _run(spark, rows, k):
    fit, d = whitening.fit_list(rows)
    model = whitening.fit(fit, d)
    return model, whitening.identity_error(fit, model, k), whitening.whiten(rows, model, k).collect()


def test_components_and_deviations(spark, vectors):
    model, error, got = _run(spark, _frame(spark, vectors), 4)
    x = np.array(sorted({_whole(v) for v in vectors}), dtype=object)
    n, sums = len(x), x.sum(0)
    c = x.astype(float) - (sums / n).astype(float)
    values, columns = np.linalg.eigh(c.T @ c / n)
    assert model.n == n and list(model.sums) == list(sums)
    assert np.allclose(model.eigenvalues, values[::-1], rtol=1e-9) and math.isclose(model.trace, values.sum(), rel_tol=1e-12)
    assert error < 1e-9
    for k in range(4):
        assert abs(model.components[k] @ columns[:, -1 - k]) == pytest.approx(1, abs=1e-9)
    assert len(got) == len(vectors)
    for r in got:
        w = np.array(_whole(vectors[r.id]), dtype=object)
        assert int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(w, sums))
        assert np.allclose(r.whitened, (w.astype(float) - (sums / n).astype(float)) @ model.components[:4].T / np.sqrt(model.eigenvalues[:4]), atol=1e-9)


def test_ill_conditioned_and_missing_directions(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**20), 2**20, (300, 3))
    thin = base[:, :1] * 3 + rng.integers(-1, 2, (300, 1))           # almost along the first
    v = np.concatenate((base, thin, base[:, 1:2] - base[:, 2:3], np.full((300, 1), 9)), 1) / 256
    rows = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    model, error, got = _run(spark, rows, 6)
    x = v * 256
    c = x - x.mean(0)
    s = np.linalg.svd(c, compute_uv=False)[:4]
    assert len(model.eigenvalues) == 4 and np.allclose(model.eigenvalues, s**2 / len(x), rtol=1e-6) and error < 1e-6
    assert all(len(r.whitened) == 4 for r in got) and model.passes > 1


def test_rows_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [3.0, -1.0], [0.5, 0.25], [3.0, -1.0]]
    odd = [None, [], [1.0, None], [nan, 1.0], [1.0, inf], [-inf, 0.0], [1.0], [1.0, 2.0, 3.0]]
    rows = _frame(spark, good).union(_frame(spark, odd, 100)).union(spark.createDataFrame([(None, [9.0, 9.0], 1, 2, 3, 4)], SCHEMA))
    model, error, got = _run(spark, rows, 4)
    assert model.n == 4 and error < 1e-12
    assert sorted((r.id for r in got), key=str) == [0, 1, 2, 3, None] and all(len(r.whitened) == 2 for r in got)


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_too_few_vectors(spark, vectors):
    rows = _frame(spark, vectors)
    model, error, got = _run(spark, rows, 4)
    assert error == 0 and all(len(r.whitened) == 0 for r in got)


def test_huge_entries(spark):
    rows = spark.createDataFrame([(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [1.0, 5e15])], "vec_id long, embedding array<double>")
    model, _, got = _run(spark, rows, 2)
    assert model.n == 3 and len(got) == 3 and all(np.isfinite(r.whitened).all() for r in got)


def test_query(spark, sf_dir):
    got = queries.op11(spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert got.count() == 4 * rows.count() and got.select(F.max("identity_error")).first()[0] < 1e-9
    w = np.array([r[0] for r in got.orderBy("vec_id", "component").select("whitened").collect()]).reshape(-1, 4)
    assert np.allclose(np.cov(w.T, bias=True), np.eye(4), atol=1e-6)
