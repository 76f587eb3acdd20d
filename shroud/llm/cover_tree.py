"""Exact top-k by inner product with dual cover trees (operator 4).

The top of the tree is a net of at most ``NODES`` centres, taken farthest-first
from a bounded sample; every row belongs to its nearest centre, and a node's
covering radius is the largest distance of all its rows. A node's rows are dealt
into blocks of about ``BLOCK`` rows, so a node that holds a third of the table
is many blocks; queries are grouped by node in the same way.

1. Every query group searches one block of its own node: each query's kth score
   there is a lower bound, and the worst of a group is the group's.
2. A group meets only the nodes whose bound (inner product of the centres, plus
   what the covering radii allow) reaches its worst kth score. Within a block
   both sides are indexed by cover trees again, and pairs of tree nodes are
   pruned by the same bound against the current worst kth score below the query
   node. Leaves are compared by one matrix product, exact in whole numbers.
3. The at most k rows of each (query, block) are merged by a window per query.

Only the node table, at most ``NODES`` rows, comes to the driver.

Defined results: vectors that are null, empty, of another length than most, or
hold null or non-finite components take no part, nor do null ids; rows that
share the query's id are its own; a repeated candidate row counts each time,
repeated queries once; an empty table gives no rows; other columns are ignored.
Scores are whole numbers to the end; a score that does not fit in a long (about
|query| * |row| * scale**2 of 2**63 and more) fails the job with a message.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import materialize, python_workers
from shroud.llm.vectors import is_query, matrix, merged, once_per_id, valid_vectors, vector_column

NODES = 32
SAMPLE = 2_000
BLOCK = 4_096
#: Queries that meet a block in one task.
GROUP = 2_048
#: Points of a leaf of the data and of the queries at most (or more where all are equal).
LEAF, QUERY_LEAF = 64, 16
#: A node whose net would have children of fewer points than this on average stays a leaf: points that lie so far
#: apart can't be pruned, and one product compares them faster than many small ones.
SPREAD = 8
#: Below every score.
NOTHING = -(2**63 - 1)
#: Radius of a child net over its parent's.
SHRINK = 0.75


class CoverTree:
    """Nested nets: children's centres are more than the child radius apart and cover the parent's points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.norm: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._add(np.arange(len(points)), 0)

    def _add(self, idx: np.ndarray, first: int) -> int:
        centre = self.points[idx[first]]
        distance = np.sqrt(((self.points[idx] - centre) ** 2).sum(1))
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(distance.max()))
        self.norm.append(float(np.sqrt((centre**2).sum())))
        self.members.append(idx)
        self.children.append([])
        if len(idx) > self.leaf and self.radius[node] > 0:
            reach, rest, nets = self.radius[node] * SHRINK, idx, []
            while len(rest) and len(nets) <= len(idx) // SPREAD:
                d = ((self.points[rest] - self.points[rest[0]]) ** 2).sum(1)
                near = d <= reach * reach
                nets.append(rest[near])
                rest = rest[~near]
            if not len(rest):
                self.children[node] = [self._add(net, 0) for net in nets]
        return node

    @property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.centre), np.array(self.radius), np.array(self.norm)


def bound(cq, rq, nq, cr, rr, nr):
    """The largest inner product of points within the radii of the centres, with room for rounding."""
    top = cq @ cr.T + nq * rr + nr * rq + rq * rr
    return top + 1e-9 * np.abs(top) + 1e-6


class TopK:
    """The k best (score, id) of each query so far."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k = query_ids, k
        self.score = np.full((len(query_ids), k), NOTHING, np.int64)
        self.vec = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        self.worst = np.maximum(floor, NOTHING).astype(np.int64)  # a known lower bound of the kth score

    def offer(self, rows: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        own = self.ids[rows][:, None] == vec[None, :]
        useful = (score >= self.worst[rows][:, None]) & ~own
        some = np.flatnonzero(useful.any(1))
        if not len(some):
            return
        rows, cols = rows[some], np.flatnonzero(useful.any(0))
        useful, score, vec = useful[np.ix_(some, cols)], score[np.ix_(some, cols)], vec[cols]
        every = np.where(useful, score, NOTHING)
        ids = np.where(useful, vec[None, :], np.iinfo(np.int64).max)
        every = np.concatenate([self.score[rows], every], 1)
        ids = np.concatenate([self.vec[rows], ids], 1)
        by = np.lexsort((ids, -every), axis=1)[:, : self.k]
        self.score[rows], self.vec[rows] = np.take_along_axis(every, by, 1), np.take_along_axis(ids, by, 1)
        self.worst[rows] = np.maximum(self.worst[rows], self.score[rows, -1])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles while they fit, else in 64-bit integers (whose sums may wrap
    on the way, but not in the end)."""
    about = q @ x.T
    if not about.size or np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53:
        return about.astype(np.int64)
    if not np.abs(about).max() < 2.0**63 * (1 - 1e-9) or not max(np.abs(q).max(), np.abs(x).max()) < 2.0**63:
        raise OverflowError("a score does not fit in a long")
    return q.astype(np.int64) @ x.astype(np.int64).T


def dual_search(queries: CoverTree, data: CoverTree, vec: np.ndarray, top: TopK) -> None:
    if not queries.centre or not data.centre:
        return
    cq, rq, nq = queries.arrays
    cr, rr, nr = data.arrays
    stack = [(0, 0)]
    while stack:
        a, b = stack.pop()
        worst = top.worst[queries.members[a]].min()
        if bound(cq[a], rq[a], nq[a], cr[b], rr[b], nr[b]) < worst:
            continue
        kids_a, kids_b = queries.children[a], data.children[b]
        if not kids_a and not kids_b:
            rows, cols = queries.members[a], data.members[b]
            top.offer(rows, products(queries.points[rows], data.points[cols]), vec[cols])
        elif kids_b and (not kids_a or rr[b] >= rq[a]):
            over = bound(cq[a], rq[a], nq[a], cr[kids_b], rr[kids_b], nr[kids_b])
            keep = np.flatnonzero(over >= worst)
            stack += [(a, kids_b[i]) for i in keep[np.argsort(over[keep])]]  # the most promising last, so first out
        else:
            stack += [(k, b) for k in kids_a]


def _nodes(points: DataFrame, nodes: int, sample: int) -> np.ndarray:
    """Centres: farthest-first over a bounded sample (the rows with the smallest hash of their id)."""
    rows = points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).select("v").collect()
    x = np.array([r["v"] for r in rows], np.float64)
    if not len(x):
        return x
    picked, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < min(nodes, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def _assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """``points`` with node and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
            node = d.argmin(1)
            far = np.sqrt(((x - centres[node]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), vector_column(x), pa.array(node, pa.int32()), pa.array(far)],
                names=["vec_id", "v", "node", "far"])

    return points.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, node int, far double")


def top_k(df: DataFrame, query_every: int = 20, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vector: str = "embedding", nodes: int = NODES, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``query_every``, over all rows."""
    python_workers(df.sparkSession)
    whole = valid_vectors(df, id_col, vector).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    whole = materialize(whole, "whole-vectors")
    centres = _nodes(whole, nodes, SAMPLE)
    if not len(centres):
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = materialize(_assigned(whole, centres), "tree-nodes")
    stats = {r["node"]: r for r in placed.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    blocks = {c: -(-r["n"] // block) for c, r in stats.items()}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]), F.col("node"))
    data = placed.select("vec_id", "v", "node", F.pmod(F.xxhash64("vec_id"), n_blocks).cast("int").alias("part"))

    asked = once_per_id(placed.filter(is_query(query_every)))
    per_node = {r["node"]: r["n"] for r in placed.filter(is_query(query_every)).groupBy("node").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    groups = F.element_at(F.create_map(*[F.lit(x) for c in blocks for x in (c, -(-per_node.get(c, 1) // group))]), F.col("node"))
    asked = _assigned(asked, centres).select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "node", "far",
        F.pmod(F.xxhash64("vec_id"), groups).cast("int").alias("part"))
    asked = materialize(asked, "queries")

    # 1: a lower bound of each query's kth score from one block of its own node
    own = asked.select("query_id", "q", F.lit(NOTHING).cast("long").alias("floor"), "node", F.lit(0).alias("part"),
                       F.col("part").alias("grp"))
    floors = _searched(data, own, k, with_scores=False).groupBy("query_id").agg(F.max("score").alias("floor"))
    asked = materialize(asked.join(floors, "query_id", "left").withColumn(
        "floor", F.coalesce("floor", F.lit(NOTHING).cast("long"))), "query-floors")

    # 2: per group, the nodes that can still hold a better row
    grouped = asked.groupBy("node", F.col("part").alias("grp")).agg(
        F.min("floor").alias("worst"), F.max("far").alias("radius"))
    names = sorted(stats)
    radius = np.array([stats[c]["radius"] for c in names])
    norm = np.sqrt((centres**2).sum(1))

    def reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for node, grp, worst, far in zip(*[c.to_pylist() for c in b.columns], strict=True):
                over = bound(centres[node], far, norm[node], centres[names], radius, norm[names])
                out += [(node, grp, names[i], blocks[names[i]]) for i in np.flatnonzero(over >= worst)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in cols], names=["node", "grp", "to", "parts"])

    met = materialize(grouped.mapInArrow(reachable, "node int, grp int, to int, parts int"), "node-pairs")
    targets = met.select("node", "grp", "to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to_part"))
    sent = asked.withColumnRenamed("part", "grp").join(targets, ["node", "grp"]).select(
        "query_id", "q", "floor", F.col("to").alias("node"), F.col("to_part").alias("part"),
        F.xxhash64("node", "grp").alias("grp"))
    found = _searched(data, sent, k, with_scores=True)
    return merged(found, k)


def _searched(data: DataFrame, queries: DataFrame, k: int, with_scores: bool) -> DataFrame:
    """Dual-tree search of every (block, query group) that ``queries`` names: (query_id, vec_id, score) of at most
    k rows per query and block; or, without scores, one row per query with its kth score."""
    pairs = queries.select("node", "part", F.col("grp").alias("met_by")).distinct()
    held = data.join(pairs, ["node", "part"])  # a block once for every query group that meets it

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        vec, x = left.column("vec_id").to_numpy(), matrix(left.column("v"))
        ids, q = right.column("query_id").to_numpy(), matrix(right.column("q"))
        top = TopK(ids, k, right.column("floor").to_numpy())
        if len(x) and len(q):
            dual_search(CoverTree(q, QUERY_LEAF), CoverTree(x), vec, top)
        if not with_scores:
            return pa.table({"query_id": ids, "vec_id": np.zeros(len(ids), np.int64), "score": top.worst})
        real = top.score > NOTHING
        row = np.nonzero(real)[0]
        return pa.table({"query_id": ids[row], "vec_id": top.vec[real], "score": top.score[real]})

    return held.groupBy("node", "part", "met_by").cogroup(queries.groupBy("node", "part", "grp")).applyInArrow(
        search, "query_id long, vec_id long, score long")
