"""Approximate nearest neighbours by adaptive dimension scans of probed lists (operator 10).

Largest inner product becomes nearest Euclidean neighbour by one more component,
sqrt(longest**2 - |x|**2), 0 for queries, which are brought to that length first
(that changes no order). Vectors are turned by a fixed random rotation, so the
first columns of a difference estimate the whole of it. Rows over ``FAR`` times as
long as 99 % of the rows would leave all others alike: they are a list of their
own, which every query scans in full.

The index is a set of lists around centres fitted by k-means to a bounded sample
(the rows with the smallest hash of their id); every row is in its nearest
list. A list is dealt into blocks of about ``BLOCK`` rows by a hash of the id, so
a list that holds a third of the table is many blocks.

1. A query scans one block of its nearest list: its kth distance there is an
   upper bound.
2. It scans the lists nearest to it, as many as a sample of ``CALIBRATION`` queries
   needs for the share ``TARGET`` of its true neighbours, found by comparing the sample
   with all rows (or the share ``probes`` of the lists). Columns come in
   groups; after each group a pair whose scaled partial distance exceeds the bound by more than
   the test allows (a factor of 1 + ``EPSILON`` / sqrt(columns)) is abandoned.
   Pairs that survive all columns have their exact distance.
3. The best of every block get their exact score, the inner product of the
   original vectors in double precision, and are merged by a window per query.

The centres (at most ``MAX_LISTS``), the rotation and the sample's neighbours are all
that comes to the driver. Measured recall is in the README.

Defined results: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part, nor do null ids; rows
that share the query's id are its own; a repeated candidate row counts each
time, repeated queries once; a product beyond the range of a double is infinite; a query with fewer candidates than k in its lists
scans all lists; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.common import materialize, python_workers
from shroud.llm.vectors import is_query, matrix, merged, once_per_id, valid_vectors, vector_column

SAMPLE = 20_000
MAX_LISTS = 2_048
#: Queries that measure how many lists are needed, and the share of their neighbours that those must hold.
CALIBRATION, TARGET = 64, 0.98
#: How many times longer than 99 % of the rows a row of the list of long ones is, and that list's number.
FAR, LONG = 8.0, -1
BLOCK = 4_096
GROUP = 2_048
COLUMNS = 16
EPSILON = 2.1
#: Share of a block's pairs below which they are followed one by one.
DENSE = 0.1


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centres of the sample; a centre without rows keeps its place."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, nearest first."""
    d = (centres * centres).sum(1) - 2 * x @ centres.T
    if n == 1:
        return d.argmin(1)[:, None]
    part = np.argpartition(d, min(n, d.shape[1]) - 1, axis=1)[:, :n]
    return np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)


def rotation(dimension: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows, none longer than ``longest``, with the component that makes them all that long."""
    rest = np.sqrt(np.maximum(longest * longest - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def survivors(q: np.ndarray, x: np.ndarray, limit: np.ndarray, columns: int = COLUMNS,
              epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query rows, candidate rows, squared distances) of the pairs never abandoned, and how many column values
    were read. ``limit`` holds a squared distance per query that its kth neighbour does not exceed."""
    width = q.shape[1]
    slack = lambda d: (d / width) * (1 + epsilon / np.sqrt(d)) ** 2 if d < width else 1 + 1e-9
    part = np.zeros((len(q), len(x)))
    alive, at, read = np.ones(part.shape, bool), 0, 0
    # while many pairs live, a group of columns is one product over the block
    while at < width and (share := alive.mean()) > DENSE:
        cols = slice(at, min(at + columns, width))
        part += (q[:, cols] ** 2).sum(1)[:, None] - 2 * q[:, cols] @ x[:, cols].T + (x[:, cols] ** 2).sum(1)[None, :]
        read += int(share * part.size) * (cols.stop - at)
        at = cols.stop
        alive &= part <= slack(at) * limit[:, None] + 1e-9
    a, b = np.nonzero(alive)
    total = part[a, b]
    while at < width and len(a):
        cols = slice(at, min(at + columns, width))
        total = total + ((q[a, cols] - x[b, cols]) ** 2).sum(1)
        read += len(a) * (cols.stop - at)
        at = cols.stop
        keep = total <= slack(at) * limit[a] + 1e-9
        a, b, total = a[keep], b[keep], total[keep]
    return a, b, total, read


def of_length(q: np.ndarray, length: float) -> np.ndarray:
    """Rows scaled to a length, with 0 as the last component; components of any finite size."""
    q = q / np.abs(q).max(1, initial=0)[:, None]
    return np.hstack([q * (length / np.sqrt((q * q).sum(1)))[:, None], np.zeros((len(q), 1))])


def scan_all(ids: np.ndarray, q: np.ndarray, vec: np.ndarray, x: np.ndarray, k: int):
    """(query rows, ids, exact scores) of the k best rows of a block per query, every pair compared."""
    rows, found, scores = [], [], []
    for i in range(len(q)):
        other = np.flatnonzero(vec != ids[i])
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("j,ij->i", q[i], x[other])
        best = np.lexsort((vec[other], -score))[:k]
        rows.append(np.full(len(best), i))
        found.append(vec[other][best])
        scores.append(score[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def scan_block(ids: np.ndarray, q: np.ndarray, q_turned: np.ndarray, limit: np.ndarray, vec: np.ndarray, x: np.ndarray,
               x_turned: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, ids, exact scores, squared distances) of at most k rows of a block per query."""
    out: list[tuple] = []
    for at in range(0, len(q), 256):
        rows = slice(at, at + 256)
        a, b, d, _ = survivors(q_turned[rows], x_turned, limit[rows])
        other = ids[rows][a] != vec[b]
        a, b, d = a[other], b[other], d[other]
        score = np.einsum("ij,ij->i", q[rows][a], x[b])
        by = np.lexsort((vec[b], -score, a))
        a, b, d, score = a[by], b[by], d[by], score[by]
        first = np.searchsorted(a, a)
        keep = np.arange(len(a)) - first < k
        out.append((a[keep] + at, vec[b[keep]], score[keep], d[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def neighbours(df: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
               probes: float | None = None, sample: int = SAMPLE, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``query_every``, over all rows."""
    spark = df.sparkSession
    python_workers(spark)
    points = valid_vectors(df, id_col, vector).filter(F.exists("v", lambda x: x != 0))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    size = points.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(norm, 0.99, 1_000).alias("usual")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    limit = F.lit(float(size["usual"]) * FAR)
    longest = float(points.filter(norm <= limit).agg(F.max(norm)).first()[0])
    picked = points.filter(norm <= limit).orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()
    centres = k_means(lifted(np.array([r["v"] for r in picked]), longest), lists_for(size["n"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("v"))
                with np.errstate(over="ignore"):
                    long = ~((x * x).sum(1) <= longest * longest * (1 + 1e-9))
                home = nearest(lifted(np.where(long[:, None], 0, x), longest), centres, 1)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), vector_column(x), pa.array(np.where(long, LONG, home), pa.int32())],
                    names=["vec_id", "v", "list"])

    placed = materialize(
        points.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, list int"), "vector-lists")
    count = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}
    parts = {c: -(-n // block) for c, n in count.items()}
    of_list = F.create_map(*[F.lit(x) for c, n in sorted(parts.items()) for x in (c, n)])
    data = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.element_at(of_list, F.col("list"))).cast("int"))

    filled = np.array(sorted(set(count) - {LONG}))
    rows_of = np.array([count[c] for c in filled])
    asking = once_per_id(points.filter(is_query(query_every)))
    wanted = int(np.ceil(probes * len(filled))) if probes else _lists_needed(placed, asking, centres[filled], filled, longest, k)
    always = [LONG] if LONG in count else []

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            order = nearest(of_length(x, longest), centres[filled], len(filled))
            enough = rows_of[order].cumsum(1) > k  # the query itself may be one of them
            need = np.maximum(wanted, np.where(enough.any(1), enough.argmax(1) + 1, len(filled)))
            lists = pa.array([filled[o[:m]].tolist() + always for o, m in zip(order, need, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), vector_column(x), lists], names=["query_id", "q", "lists"])

    n_groups = -(-asking.count() // group)
    asked = materialize(
        asking.mapInArrow(probe, "query_id long, q array<double>, lists array<int>").withColumn(
            "grp", F.pmod(F.xxhash64("query_id"), F.lit(max(n_groups, 1))).cast("int")), "vector-queries")

    seeds = asked.select("query_id", "q", F.lit(float("inf")).alias("bound"), F.element_at("lists", 1).alias("list"),
                         F.lit(0).alias("part"), "grp")
    bounds = _scanned(data, seeds, k, longest, bounds_only=True).groupBy("query_id").agg(F.min("score").alias("bound"))
    asked = materialize(asked.join(bounds, "query_id", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf")))), "query-bounds")
    sent = asked.select("query_id", "q", "bound", "grp", F.explode("lists").alias("list")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.element_at(of_list, F.col("list")) - 1)))
    return merged(_scanned(data, sent, k, longest, bounds_only=False), k)


def _lists_needed(placed: DataFrame, asking: DataFrame, centres: np.ndarray, filled: np.ndarray, longest: float, k: int) -> int:
    """How many of its nearest lists a query must scan to meet ``TARGET`` of its true neighbours, on the ``CALIBRATION``
    queries with the smallest hash of their id, each compared with every row (one scan, k rows a task and query)."""
    rows = asking.orderBy(F.xxhash64("vec_id"), "vec_id").limit(CALIBRATION).collect()
    if not rows:
        return 1
    ids, q = np.array([r["vec_id"] for r in rows]), np.array([r["v"] for r in rows])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            vec, home, x = b.column("vec_id").to_numpy(), b.column("list").to_numpy(), matrix(b.column("v"))
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.where(ids[:, None] == vec[None, :], -np.inf, q @ x.T)
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(ids)), best.shape[1])
            at = best.ravel()
            keep = ids[row] != vec[at]
            row, at = row[keep], at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(vec[at]), pa.array(home[at], pa.int32()), pa.array(score[row, at])],
                                             names=["row", "vec_id", "list", "score"])

    near = placed.mapInArrow(compare, "row int, vec_id long, list int, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("row", "list").collect()
    place = np.empty((len(ids), len(filled)), np.int64)
    nearest_first = nearest(of_length(q, longest), centres, len(filled))
    np.put_along_axis(place, nearest_first, np.broadcast_to(np.arange(len(filled)), place.shape), 1)
    number = {int(c): i for i, c in enumerate(filled)}
    ranks = sorted(int(place[r["row"], number[r["list"]]]) for r in near if r["list"] != LONG)  # at most CALIBRATION * k
    return ranks[min(len(ranks) - 1, int(TARGET * len(ranks)))] + 1 if ranks else 1


def lists_for(n: int) -> int:
    """About the square root of the number of rows, at most MAX_LISTS."""
    return int(min(MAX_LISTS, max(1, 2 ** round(np.log2(max(n, 1)) / 2))))


def _scanned(data: DataFrame, queries: DataFrame, k: int, longest: float, bounds_only: bool) -> DataFrame:
    """(query_id, vec_id, score) of every (block, query group) that ``queries`` names; or, for bounds, one row per
    query with the squared distance of its kth neighbour there as score."""
    pairs = queries.select("list", "part", F.col("grp").alias("met_by")).distinct()
    held = data.join(pairs, ["list", "part"])  # a block once for every query group that meets it

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        vec, x = left.column("vec_id").to_numpy(), matrix(left.column("v"))
        ids, q = right.column("query_id").to_numpy(), matrix(right.column("q"))
        empty = {"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)}
        if not len(x) or not len(q):
            return pa.table(empty)
        if left.column("list")[0].as_py() == LONG:
            row, found, score = scan_all(ids, q, vec, x, k)
            return pa.table({"query_id": ids[row], "vec_id": found, "score": score})
        turn = rotation(x.shape[1] + 1)
        row, found, score, d = scan_block(
            ids, q, of_length(q, longest) @ turn, right.column("bound").to_numpy(), vec, x,
            lifted(x, longest) @ turn, k)
        if not bounds_only:
            return pa.table({"query_id": ids[row], "vec_id": found, "score": score})
        full = np.flatnonzero(np.bincount(row, minlength=len(ids)) >= k)
        worst = np.full(len(ids), -np.inf)
        np.maximum.at(worst, row, d)
        return pa.table({"query_id": ids[full], "vec_id": np.zeros(len(full), np.int64), "score": worst[full]})

    return held.groupBy("list", "part", "met_by").cogroup(queries.groupBy("list", "part", "grp")).applyInArrow(
        scan, "query_id long, vec_id long, score double")
