"""Whitening against numpy's eigenvectors on small tables."""

import math

import numpy as np
import pytest

from qacorpus.llm.whitening import one_sided_jacobi, pivoted_cholesky, principal, whiten

VECTORS = "vec_id long, embedding array<double>, x int, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c") for i, v in rows], VECTORS)


def expected(rows):
    """Kept rows with their whole numbers, and n, S, V of the different ones."""
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in whole})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * c - t) / n for c, t in zip(x, s)] for x in fit])
    return whole, n, s, centred.T @ centred / n


def compare(spark, rows, noise=()):
    whole, n, s, v = expected(rows)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    got = whiten(vectors(spark, [*rows, *noise])).collect()
    assert len(got) == 4 * len(rows)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / v.trace(), rel=1e-9)
        by.setdefault((r.id, r.component), []).append(r)
    for i, x in whole:
        c = np.array([(n * a - t) / n for a, t in zip(x, s)])
        for k in range(4):
            found = by[i, k + 1]
            assert {r.deviation for r in found} >= {sum((n * a - t) ** 2 for a, t in zip(x, s))}
            want = abs(c @ axes[:, k]) / math.sqrt(values[k])
            assert any(abs(abs(r.whitened) - want) < 1e-7 for r in found)
    for k in range(4):  # one sign for all rows
        want = {i: (np.array([(n * a - t) / n for a, t in zip(x, s)]) @ axes[:, k]) for i, x in whole}
        signs = {np.sign(want[r.id] * r.whitened) for r in got if r.component == k + 1 and abs(r.whitened) > 1e-6 and [i for i, _ in whole].count(r.id) == 1}
        assert len(signs) <= 1


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, base[3].tolist()) for k in range(50)] + [(7, base[8].tolist()), (None, base[9].tolist())]
    noise = [(2000, None), (2001, [float("nan")] + [0.0] * 11), (2002, [float("inf")] + [0.0] * 11), (2003, [None] + [0.0] * 11), (2004, []), (2005, [1.0, 2.0])]
    compare(spark, rows, noise)


def test_large_values_with_a_small_spread(spark):
    rng = np.random.default_rng(2)
    rows = [(k, (1e9 + rng.normal(size=6)).tolist()) for k in range(200)]
    compare(spark, rows)


def test_rank_and_empty(spark):
    assert whiten(vectors(spark, [])).count() == whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    assert whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = [(k, [float(k), 2.0 * k, -float(k)]) for k in range(10)]
    got = whiten(vectors(spark, line)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_factor_and_rotation():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(9, 6)) * 10.0 ** np.arange(0, -6, -1)
    v = a @ a.T
    factor, order = pivoted_cholesky(v)
    assert factor.shape[1] <= 6 and np.allclose(factor @ factor.T, v[np.ix_(order, order)])
    assert np.all(np.triu(factor[:6], 1) == 0)
    turned = one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(gram.diagonal())).max() < 1e-12
    values, axes = principal(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:4], rtol=1e-9) and np.allclose(v @ axes, axes * values, atol=1e-9)


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [5.0, 7.0])]
    assert whiten(vectors(spark, rows)).where("deviation is null").count() > 0
