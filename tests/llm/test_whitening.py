"""Whitening against plain numpy on all rows; the refinement against known spectra; edges."""

import math
from collections import defaultdict

import numpy as np
import pytest

from shroud.llm import whitening
from shroud.llm.whitening import clusters, refined, whiten

SCHEMA = "vec_id long, embedding array<double>, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7) for i, v in rows], SCHEMA)


def brute(rows, scale=1024, shift=100_000):
    x = [[math.floor(scale * c) + shift for c in v] for _, v in rows]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(n * a - b) for a, b in zip(r, s, strict=True)] for r in x]) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    return n, deviation, y, e[::-1], u[:, ::-1]


def check(got, rows, k, sign=True):
    n, deviation, y, e, u = brute(rows)
    by = defaultdict(dict)
    for r in got:
        assert r.n == n
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9)
        assert r.identity_error == got[0].identity_error < 1e-9
        by[r.vec_id, r.deviation].setdefault(r.component, []).append(r.whitened)
    assert len(got) == n * k
    want = y @ u[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        a = np.array([by[i, d][c + 1][0] for (i, _), d in zip(rows, deviation, strict=True)])
        turn = np.sign(a @ want[:, c])
        np.testing.assert_allclose(a * turn, want[:, c], atol=1e-7)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    check(whiten(df).collect(), rows, 8)


def test_skewed_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(12) * np.linspace(0.01, 30, 12) + 5).tolist()) for i in range(400)]
    rows += [(1_000, rows[0][1])] * 200
    check(whiten(table(spark, rows).repartition(6), k=5).collect(), rows, 5)


def spectrum(e, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(e), len(e))))[0].astype(np.longdouble)
    for _ in range(3):  # orthogonal beyond double precision
        q = q @ (1.5 * np.eye(len(e), dtype=np.longdouble) - q.T @ q / 2)
    v = (q * np.array(e, np.longdouble)) @ q.T
    return ((v + v.T) / 2).astype(np.float64), q.astype(np.float64)


@pytest.mark.parametrize("e", [
    np.arange(40, 0, -1.0), [1e6, 1e3, 1, 1e-2, 1e-4], [3 + 1e-7, 3, 3 - 1e-7, 1, 1 - 1e-9, 0.5], [5 + 1e-10 * i for i in range(8, 0, -1)] + [1.0]])
def test_refined_to_double_precision(e):
    e = np.array(e, float)
    v, q = spectrum(e, 1)
    values, x = refined(v)
    eps, size = np.finfo(float).eps, np.abs(e).max()
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 4 * eps
    assert np.abs(v @ x - x * values).max() < 8 * eps * size
    np.testing.assert_allclose(values, e, atol=4 * eps * size)
    for i in range(len(e)):  # the error of a vector is bounded by rounding of v over its gap
        gap = np.min(np.abs(np.delete(e, i) - e[i]))
        assert np.abs(x[:, i] * np.sign(x[:, i] @ q[:, i]) - q[:, i]).max() < 20 * eps * size / gap + 4 * eps


def test_equal_eigenvalues():
    for e in ([2.0] * 6, [4, 4, 4, 1, 1, 0, 0], [0.0] * 3):
        v, _ = spectrum(e, 2)
        values, x = refined(v)
        np.testing.assert_allclose(values, e, atol=1e-14)
        assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-15
    assert clusters(np.array([5, 4.99, 3, 1, 1, 0.0]), 0.1) == [(0, 2), (3, 5)]


def test_refinement_needs_its_steps(monkeypatch):
    v, _ = spectrum(np.linspace(1, 2, 30), 5)
    monkeypatch.setattr(whitening, "STEPS", 0)
    rough = np.abs(v @ refined(v)[1] - refined(v)[1] * refined(v)[0]).max()
    monkeypatch.setattr(whitening, "STEPS", 12)
    assert rough > 1e-8 > 1e-14 > np.abs(v @ refined(v)[1] - refined(v)[1] * refined(v)[0]).max()


def test_edges(spark):
    good = [(1, [1.0, 2.0, 0.5]), (2, [0.0, 1.0, 1.0]), (None, [3.0, 1.0, 2.0]), (4, [1.0, 1.0, 1.0]), (4, [1.0, 1.0, 1.0])]
    bad = [(5, None), (6, []), (7, [1.0, None, 2.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (10, [1.0, 2.0])]
    check(whiten(table(spark, good + bad)).collect(), good, 3)
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(5, None)])).collect() == []
    for rows in ([(1, [2.0, 3.0])], [(i, [0.25, 0.5]) for i in range(5)]):  # no variance at all
        out = whiten(table(spark, rows)).collect()
        assert len(out) == 2 * len(rows)
        assert all((r.whitened, r.explained, r.deviation, r.identity_error) == (None, None, 0, 0.0) for r in out)
    flat = [(i, [float(i), 2.0 * i, 1.0]) for i in range(6)]  # one direction
    out = whiten(table(spark, flat)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in out)
    assert all(r.identity_error < 1e-12 for r in out)


def test_large_numbers(spark):
    rows = [(i, [4e5 * i, 3.0]) for i in range(4)]
    want = brute(rows)[1]
    got = {r.vec_id: r.deviation for r in whiten(table(spark, rows)).collect()}
    assert [got[i] for i in range(4)] == want
    for rows in ([(i, [1e160 * i, 1.0]) for i in range(3)], [(i, [1e11 * i, 1.0]) for i in range(3)]):
        with pytest.raises(Exception, match="beyond|does not fit"):
            whiten(table(spark, rows)).collect()
