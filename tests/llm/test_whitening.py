"""Whitening against a plain eigensolver, and the refinement against known eigenvectors."""

import math
import random

import numpy as np
import pytest

from traceline.llm.whitening import Fit, eigenvectors, whiten

SCHEMA = "vec_id bigint, embedding array<float>, id string, w int, component string, n int"


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA)
    return whiten(df, **options).collect()


def plain(rows, dim, k=8):
    ok = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows
          if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(ok), [sum(x[j] for _, x in ok) for j in range(dim)]
    y = [[n * a - s for a, s in zip(x, sums)] for _, x in ok]
    c = np.array(y, float) / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), range(dim)] < 0, -1, 1)
    w = c @ axes / np.sqrt(values)
    return {(i, j + 1): (n, sum(a * a for a in y[r]), w[r, j], values[j] / values.sum())
            for r, (i, _) in enumerate(ok) for j in range(min(k, dim))}


def vectors(rng, n, dim):
    return [(i, [rng.gauss(0, 1 + j) + 0.3 * j for j in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("dim,k", [(3, 8), (10, 8), (10, 2)])
def test_equals_plain(spark, dim, k):
    rows = vectors(random.Random(dim), 200, dim)
    odd = [(1000, None), (1001, [1.0] * (dim - 1) + [None]), (1002, [float("nan")] * dim), (1003, [float("inf")] * dim),
           (1004, []), (1005, [1.0] * (dim + 1))]
    got = run(spark, rows + odd, k=k)
    want = plain(rows, dim, k)
    assert {(r.id, r.component) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        n, deviation, w, share = want[r.id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(w, rel=1e-9, abs=1e-9) and r.explained == pytest.approx(share, rel=1e-10)
        assert r.identity_error < 1e-10


def test_edges(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, []), (3, [None])]) == []
    same = run(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])])
    assert len(same) == 6 and all((r.deviation, r.whitened, r.explained, r.identity_error) == (0, None, None, None) for r in same)
    flat = run(spark, [(2 ** 60 + 1, [1.0, 1.0]), (None, [3.0, 3.0]), (7, [5.0, 5.0])])
    assert {r.id for r in flat} == {2 ** 60 + 1, None, 7}
    assert all((r.whitened is None) == (r.component == 2) for r in flat)
    assert {round(r.whitened, 6) for r in flat if r.component == 1} == {round(x * math.sqrt(1.5), 6) for x in (-1, 0, 1)}


def test_out_of_range(spark):
    with pytest.raises(Exception, match="2\\^46"):
        run(spark, [(1, [1e30]), (2, [0.0])])


def test_exact_integers():
    fit = Fit(3 * 10 ** 12, (3 * 10 ** 12 * 99990 + 7,))
    x = np.array([[100000], [99990]])
    assert fit.scaled(x).tolist() == [[3 * 10 ** 13 - 7], [-7]]
    with pytest.raises(OverflowError):
        fit.deviations(x)
    assert Fit(10 ** 6, (10 ** 11,)).deviations(np.array([[100001]])) == [10 ** 12]


@pytest.mark.parametrize("gaps", [
    [1e-1] * 9, [1e-9] * 9, [1e-1, 1e-10, 1e-10, 1e-1, 1e-6, 1e-8, 1e-10, 1e-1, 1e-1], [1e-3] * 4 + [0.0] * 5])
def test_clustered_eigenvalues(gaps):
    rng = np.random.default_rng(5)
    n = len(gaps) + 1
    q = np.linalg.qr(rng.normal(size=(n, n)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (1.5 * np.eye(n) - 0.5 * (q.T @ q))
    want = 1 + np.concatenate(([0], np.cumsum(np.array(gaps, np.longdouble))))[::-1]
    a = q @ np.diag(want) @ q.T
    values, x = eigenvectors(a)
    assert np.abs(values - want.astype(float)).max() < 1e-15 * n * float(want.max())
    assert np.abs(x.T @ x - np.eye(n)).max() < 1e-14
    distinct = [i for i in range(n) if all(abs(want[i] - want[j]) > 1e-12 for j in range(n) if i != j)]
    near = np.abs(np.diag(q.T.astype(float) @ x))
    assert np.abs(near[distinct] - 1).max(initial=0) < 1e-12
    assert np.abs(a.astype(float) @ x - x * values).max() < 1e-13


def test_wide_range_of_eigenvalues():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    want = 10.0 ** -np.arange(12)
    values, x = eigenvectors((q * want) @ q.T)
    assert np.allclose(values, want, rtol=1e-3, atol=1e-15)
    assert np.abs(x.T @ x - np.eye(12)).max() < 1e-14
    assert eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
