"""Both vector searches at the ends of their ranges, and recall beyond the smallest table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import adaptive_scan, cover_tree

SCHEMA = "vec_id long, embedding array<double>"


def exact_longs(rows, every, k):
    out = {}
    for i, q in rows:
        if i % every == 0:
            found = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i)
            out[i] = [(-s, j) for s, j in found[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"nodes": 4, "block": 20, "group": 3}])
def test_scores_past_doubles_are_exact(spark, options):
    rng = np.random.default_rng(1)
    for scale, low in ((1, 3 * 10**8), (64, 3 * 10**6)):
        rows = [(i, [float(x) for x in rng.integers(low, low + 50, 5)]) for i in range(80)]
        got = {}
        for r in cover_tree.top_k(spark.createDataFrame(rows, SCHEMA), query_every=10, k=6, scale=scale, **options).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
        want = exact_longs([(i, [x * scale for x in v]) for i, v in rows], 10, 6)
        assert min(s for w in want.values() for s, _ in w) > 2**53
        assert {q: [w[n] for n in sorted(w)] for q, w in got.items()} == want


@pytest.mark.parametrize("size", [1e18, 1e10, 1e200])
def test_scores_beyond_a_long_fail(spark, size):
    rows = [(i, [size, 1.0 * i]) for i in range(30)]
    with pytest.raises(Exception, match="does not fit in a long"):
        cover_tree.top_k(spark.createDataFrame(rows, SCHEMA)).collect()


def test_a_huge_vector_takes_part_and_hides_no_other(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(2_000)]
    huge = [(2_001, [1e160] * 16), (2_002, [-1e160] * 16), (2_020, [1e155, 1.0] + [0.0] * 14)]
    got = {}
    for r in adaptive_scan.neighbours(spark.createDataFrame(rows + huge, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    hits = total = 0
    for i, v in rows:
        if i % 20:
            continue
        found = [j for _, j in sorted(got[i])]
        assert len(found) == 20
        upper = [j for j, h in huge if np.dot(np.array(h) / 1e150, v) > 1]
        assert set(found[: len(upper)]) == set(upper) and not {2_001, 2_002, 2_020} - set(upper) & set(found)
        rest = ids[np.lexsort((ids, -(x @ v)))]
        want = rest[rest != i][: 20 - len(upper)].tolist()
        hits += len(set(want) & set(found))
        total += len(want)
    assert hits >= 0.95 * total
    assert len(got[2_020]) == 20


@pytest.mark.parametrize("table", ["sf0.1", "check_s"])
def test_recall_on_larger_tables(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").select("vec_id", "embedding")
    rows = [r for r in df.collect() if r.embedding and all(c is not None and np.isfinite(c) for c in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in rows], np.float64)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in adaptive_scan.neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0)[:400]:
        score = x @ x[i]
        score[ids == ids[i]] = -np.inf
        want = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits += len(want & got[int(ids[i])])
        total += 20
    print(table, hits / total)
    assert hits >= 0.95 * total


def test_calibration_scans_fewer_than_all_lists(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.standard_normal(16)).tolist()) for i in range(4_000)]
    points = spark.createDataFrame(rows, SCHEMA).select("vec_id", F.col("embedding").alias("v"))
    x = np.array([v for _, v in rows])
    longest = float(np.sqrt((x * x).sum(1)).max())
    fitted = adaptive_scan.k_means(adaptive_scan.lifted(x, longest), 64)
    home = adaptive_scan.nearest(adaptive_scan.lifted(x, longest), fitted, 1)[:, 0]
    filled = np.unique(home)
    placed = spark.createDataFrame([(i, v, int(h)) for (i, v), h in zip(rows, home, strict=True)], "vec_id long, v array<double>, list int")
    need = adaptive_scan._lists_needed(placed, points.filter("vec_id % 20 = 0"), fitted[filled], filled, longest, 20)
    assert 1 <= need < len(filled) / 2
