"""Whitening against an eigensolver on the covariance, and its edge cases."""

import math
import random

import numpy as np
import pytest

from timbral.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors):
    """Integers, count, deviations, eigenvalues and vectors by numpy's symmetric solver."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = (n * x - total) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum(int(d) ** 2 for d in row) for row in n * x - total]
    return n, centred, deviation, values[::-1], components[:, ::-1]


def made(n, width, seed):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) @ (rng.normal(size=(width, width)) * np.linspace(3, 0.2, width))).astype(np.float32)


@pytest.mark.parametrize(("n", "width", "parts"), [(700, 12, 5), (300, 40, 1), (9000, 7, 3)])
def test_as_an_eigensolver(spark, n, width, parts):
    rows = made(n, width, n)
    df = spark.createDataFrame([(k, r.tolist(), 0) for k, r in enumerate(rows)], SCHEMA).repartition(parts)
    found = whitening.whiten(df).toPandas()
    count, centred, deviation, values, components = plain(rows)
    k = min(32, width)
    assert len(found) == n * k and set(found.n) == {count}
    first = found[found.component == 1].set_index("vec_id")
    assert first.deviation.loc[list(range(n))].tolist() == deviation
    explained = found.groupby("component").explained.agg(["min", "max"])
    assert (explained["min"] == explained["max"]).all()
    assert np.allclose(explained["min"], values[:k] / values.sum(), rtol=1e-9)
    got = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = centred @ components[:, :k] / np.sqrt(values[:k])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7
    error = np.abs(np.cov(got.T, bias=True) - np.eye(k)).max()
    assert found.identity_error.nunique() == 1 and abs(found.identity_error[0] - error) < 1e-9 and error < 1e-9


def test_edge_rows(spark):
    good = made(60, 5, 1).tolist()
    rows = [(k, v, 1) for k, v in enumerate(good)]
    odd = [(None, good[3], 1), (7, good[7], 2), (100, None, 1), (101, [1.0, None, 2.0, 3.0, 4.0], 1), (102, [1.0, math.nan, 0.0, 0.0, 0.0], 1), (103, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (104, [1.0, 2.0], 1), (105, [], 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "7 AS n", "'x' AS component", "1.5 AS whitened")
    found = whitening.whiten(df).toPandas()
    count, _, deviation, _, _ = plain(good + [good[3], good[7]])
    assert set(found.n) == {62} == {count}
    assert len(found) == 62 * 5 and list(found.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(found[found.component == 1].deviation) == sorted(deviation)
    assert found.vec_id.isna().sum() == 5 and not found.vec_id.isin(range(100, 106)).any()


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [0.5, 2.0], 0)], [(k, [0.25, 1.0], 0) for k in range(9)]])
def test_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_dependent_dimensions(spark):
    """Two columns that are multiples, one constant: as many components as there are directions."""
    rng = random.Random(4)
    base = [[rng.randrange(-400, 400) / 64 for _ in range(3)] for _ in range(80)]
    rows = [(k, [*b, 2 * b[0], 1.0], 0) for k, b in enumerate(base)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(found.component) == {1, 2, 3} and found.identity_error[0] < 1e-9 and abs(found.groupby("component").explained.first().sum() - 1) < 1e-12


def test_deviation_beyond_64_bits_in_steps():
    x = np.array([[5, 9], [1_000_000, 3]], np.int64)
    total = np.array([10**17, 7], np.int64)
    assert whitening._deviation(x, 1 << 35, total) == [sum(((1 << 35) * int(v) - int(s)) ** 2 for v, s in zip(row, total, strict=True)) for row in x]


def test_rotations_keep_relative_accuracy():
    """Columns of sizes from 1 to 1e-12: singular values to many digits, vectors orthogonal."""
    rng = np.random.default_rng(9)
    sizes = 10.0 ** -np.arange(0, 13, 2)
    basis, _ = np.linalg.qr(rng.normal(size=(50, 7)))
    lengths, vectors = whitening.one_sided_jacobi(basis * sizes)
    assert np.allclose(lengths, sizes, rtol=1e-12) and np.abs(vectors.T @ vectors - np.eye(7)).max() < 1e-13
