"""Both vector searches against brute force."""

import math
import random

import numpy as np
import pytest

from shroud.llm import adaptive_scan, cover_tree

SCHEMA = "vec_id long, embedding array<float>, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def valid(rows, dimension, zero=True):
    for i, v in rows:
        if i is not None and v and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            yield i, np.array(v, np.float32).astype(np.float64)


def exact(rows, every, k, f):
    """{query: [(score, id), ...]} by comparing everything."""
    rows = [(i, f(v)) for i, v in rows]
    out = {}
    for i, q in sorted(rows, key=lambda r: list(r[1]), reverse=True):
        if i % every == 0:
            found = sorted((-float(q @ v), j) for j, v in rows if j != i)
            out[i] = [(-s, j) for s, j in found[:k]]
    return out


def ranked(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(n, d, seed, spread=0.2, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, d))
    return [(i, (centres[rng.integers(clusters)] + spread * rng.standard_normal(d)).tolist()) for i in range(n)]


whole = lambda v: np.floor(64 * v)


@pytest.mark.parametrize("options", [{}, {"nodes": 5, "block": 40, "group": 4}])
def test_cover_tree(spark, options):
    rows = clustered(500, 12, 1)
    rows += [(600 + i, rows[3][1]) for i in range(90)]  # a hot group of equal vectors
    got = ranked(cover_tree.top_k(table(spark, rows), query_every=10, k=7, **options).collect())
    assert got == exact(valid(rows, 12), 10, 7, whole)


def test_cover_tree_prunes():
    rows = clustered(2_000, 6, 2, spread=0.01, clusters=12)
    x = whole(np.array([v for _, v in rows]))
    q, data = cover_tree.CoverTree(x[::20], cover_tree.QUERY_LEAF), cover_tree.CoverTree(x)
    for t in (q, data):  # covering, and children that are a net of their parent
        for node, kids in enumerate(t.children):
            far = np.sqrt(((x[::20] if t is q else x)[t.members[node]] - t.centre[node]) ** 2).sum(1)
            assert t.radius[node] <= far.max() + 1e-9
            if kids:
                assert sorted(np.concatenate([t.members[k] for k in kids])) == sorted(t.members[node])
    compared = 0
    real = cover_tree.products

    def counted(a, b):
        nonlocal compared
        compared += len(a) * len(b)
        return real(a, b)

    top = cover_tree.TopK(np.arange(0, 2_000, 20), 5, np.full(100, -np.inf))
    cover_tree.products = counted
    try:
        cover_tree.dual_search(q, data, np.arange(2_000), top)
    finally:
        cover_tree.products = real
    assert compared < 0.6 * 100 * 2_000
    want = exact([(i, np.array(v)) for i, v in rows], 20, 5, whole)
    assert {i: [(s, j) for s, j in zip(top.score[r], top.vec[r], strict=True)] for r, i in enumerate(range(0, 2_000, 20))} == want


def test_large_whole_numbers_stay_exact():
    q, x = np.array([[2.0**30 + 1, 3]]), np.array([[2.0**30 - 1, 5], [1, 1]])
    assert cover_tree.products(q, x).tolist() == [[2**60 - 1 + 15, 2**30 + 4]]


@pytest.mark.parametrize("options", [{"block": 50, "group": 5}, {"probes": 1.0}])
def test_adaptive_scan(spark, options):
    rows = [(i, [x * (1 + i % 3) for x in v]) for i, v in clustered(600, 24, 3, 0.5)]
    rows += [(700 + i, rows[4][1]) for i in range(120)]
    got = ranked(adaptive_scan.neighbours(table(spark, rows), query_every=10, k=7, **options).collect())
    want = exact(valid(rows, 24), 10, 7, lambda v: v)
    assert got.keys() == want.keys()
    vectors = dict(valid(rows, 24))
    hits = 0
    for i, found in got.items():
        assert len(found) == 7 and found == sorted(found, key=lambda x: (-x[0], x[1]))
        assert all(s == pytest.approx(float(vectors[i] @ vectors[j]), rel=1e-12) for s, j in found)
        hits += len({j for _, j in found} & {j for _, j in want[i]})
    assert hits >= 0.9 * 7 * len(want)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = list(valid([(r.vec_id, r.embedding) for r in df.collect()], 64))
    want = exact(rows, 20, 20, lambda v: v)
    got = ranked(adaptive_scan.neighbours(df).collect())
    assert sum(len({j for _, j in got[i]} & {j for _, j in w}) for i, w in want.items()) >= 0.9 * 20 * len(want)


def test_tests_abandon_early_and_keep_the_near():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3_000, 64))
    q = x[:50] + 0.3 * rng.standard_normal((50, 64))
    d = ((q[:, None] - x[None]) ** 2).sum(2)
    limit = np.sort(d, 1)[:, 9]
    a, b, total, read = adaptive_scan.survivors(q, x, limit)
    near = {(i, j) for i in range(50) for j in np.argsort(d[i])[:10]}
    assert len(near & set(zip(a, b, strict=True))) >= 0.98 * len(near)
    np.testing.assert_allclose(total, d[a, b])
    assert read < 0.9 * d.size * 64


@pytest.mark.parametrize("search", [cover_tree.top_k, adaptive_scan.neighbours])
def test_edges(spark, search):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(1, 30)]
    rows += [(40, None), (60, []), (80, [1.0, None, 0.0, 0.0]), (100, [float("nan"), 0.0, 0.0, 0.0]), (120, [float("inf"), 0.0, 0.0, 0.0]),
             (140, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0]), (160, [0.5, 0.5, 0.1, 0.2]), (160, [0.5, 0.5, 0.1, 0.2]), (7, rows[6][1])]
    f = whole if search is cover_tree.top_k else (lambda v: v)
    got = ranked(search(table(spark, rows), k=50).collect())
    want = exact(valid(rows, 4, zero=False), 20, 50, f)
    assert {i: [j for _, j in w] for i, w in got.items()} == {i: [j for _, j in w] for i, w in want.items()}
    assert search(table(spark, [])).collect() == []
    assert search(table(spark, [(20, [1.0, 2.0])])).collect() == []


def test_zero_vectors(spark):
    rows = [(i, [0.0, 0.0]) for i in range(20, 26)] + [(40, [1.0, 0.0]), (41, [0.0, 1.0])]
    assert {r.vec_id for r in adaptive_scan.neighbours(table(spark, rows)).collect()} == {41}
    assert {r.query_id for r in cover_tree.top_k(table(spark, rows)).collect()} == {20, 40}
