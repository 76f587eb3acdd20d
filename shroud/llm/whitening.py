"""Whitening of vectors by the eigenvectors of their covariance, refined to double precision (operator 13).

Components become whole numbers x = floor(scale * c) + shift. Four scans of the vectors, none of which shuffles one:

1. the most frequent length, then the number of rows and every dimension's sum, exact;
2. every task's products of its rows, centred by the exact mean before they are multiplied, added up with a
   compensation for rounding; the sums of the tasks meet by row of the matrix;
3. the same for the whitened components, which gives ``identity_error`` as measured on the data;
4. the rows themselves.

Only matrices of d x d numbers (d: the length of a vector, 64 here) come to the driver, whatever the number of rows;
a task's products go out as d rows of d numbers. The eigenvectors start as those of the float32 covariance and are
corrected by the iteration of Ogita and Aishima: with R = I - X'X and S = X'VX, X <- X + XE, where E solves the first
order of both conditions at once; every step is a few matrix products in extended precision and doubles the correct
digits. Eigenvalues too close for the current accuracy are no longer told apart by E; each such cluster is solved as a small
problem of its own, shifted by its mean (``refined``).

Defined results: vectors that are null, empty, of another length than most, or hold null or non-finite components take
no part; null ids stay; repeated rows count and come back each time; an empty table gives no rows; other columns are
ignored. A direction without variance (an eigenvalue within rounding of 0 beside the largest) has null as its whitened
component and is left out of ``identity_error``; ``explained`` is null if all vectors are equal. scale * |c| must be below 2**52,
and ``deviation`` must fit in a long (about n * scale * |c - mean| * sqrt(d) < 3e9): beyond, the job fails with a
message instead of returning wrapped numbers. d is at most ``MAX_DIMENSION``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import partitions_for, python_workers
from shroud.llm.vectors import matrix

MAX_DIMENSION = 4_096
#: Eigenvalues below this share of the largest (times d) are rounding of 0.
FLAT = 16 * np.finfo(np.float64).eps
STEPS = 12
OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def refined(v: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    ``start``: approximate eigenvectors; by default those of the matrix in float32.
    """
    d = len(v)
    unit = float(np.abs(v).max()) if d else 0.0
    if unit == 0:
        return np.zeros(d), np.eye(d)
    wide = np.longdouble
    a = v.astype(wide) / wide(unit)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1] if start is None else start
    x = x.astype(wide)
    eye = np.eye(d, dtype=wide)
    size = float(np.linalg.norm(a.astype(np.float64), 2))
    for _ in range(STEPS):
        r = eye - x.T @ x
        s = x.T @ a @ x
        e = np.diag(s) / (1 - np.diag(r))
        by = np.argsort(-e, kind="stable")
        x, e, r, s = x[:, by], e[by], r[np.ix_(by, by)], s[np.ix_(by, by)]
        off = s - np.diag(np.diag(s))
        close = 2 * (np.linalg.norm(off.astype(np.float64), 2) + size * np.linalg.norm(r.astype(np.float64), 2))
        moved = False
        for lo, hi in clusters(e, close):
            turn = sub_solve(s[lo:hi, lo:hi], r[lo:hi, lo:hi], size)
            if turn is not None:
                x[:, lo:hi] = x[:, lo:hi] @ turn
                moved = True
        if moved:
            r = eye - x.T @ x
            s = x.T @ a @ x
            e = np.diag(s) / (1 - np.diag(r))
        gap = e[None, :] - e[:, None]
        far = np.abs(gap) > close
        step = np.where(far, (s + e[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ step
        if float(np.abs(step).max()) < np.finfo(np.float64).eps / 16:
            break
    x = x @ (3 * eye - x.T @ x) / 2  # what the last step left of R
    e = np.diag(x.T @ a @ x) / np.diag(x.T @ x)
    by = np.argsort(-e, kind="stable")
    x = x[:, by] / np.sqrt((x[:, by] ** 2).sum(0))
    return (e[by] * wide(unit)).astype(np.float64), x.astype(np.float64)


def clusters(e: np.ndarray, close: float) -> list[tuple[int, int]]:
    """Runs of two or more falling values, each within ``close`` of the one before."""
    ends = np.concatenate([np.flatnonzero(e[:-1] - e[1:] > close) + 1, [len(e)]])
    starts = np.concatenate([[0], ends[:-1]])
    return [(int(lo), int(hi)) for lo, hi in zip(starts, ends, strict=True) if hi - lo > 1]


def sub_solve(s: np.ndarray, r: np.ndarray, size: float) -> np.ndarray | None:
    """A turn of a cluster's vectors that makes them eigenvectors within their span, from their own matrix less its
    mean; None where what is left is rounding."""
    wide = np.longdouble
    half = np.eye(len(s), dtype=wide) + r / 2  # makes the vectors orthonormal to first order
    inner = half @ s @ half
    inner = (inner + inner.T) / 2
    inner = inner - np.eye(len(s), dtype=wide) * (np.trace(inner) / len(s))
    off = float(np.abs(inner - np.diag(np.diag(inner))).max())
    if off <= 4 * float(np.finfo(wide).eps) * size:
        return None
    values, turn = np.linalg.eigh((inner / wide(np.abs(inner).max())).astype(np.float64))
    return half @ turn[:, np.argsort(-values)].astype(wide)


@dataclass
class Fit:
    """What the transformation needs: n, exact sums, eigenvalues, eigenvectors, and the measured error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    scale: int
    shift: int
    identity_error: float = 0.0

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)  # n * mean = n * whole + rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def weights(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(d x k matrix, which of its columns have variance)."""
        e = self.values[:k]
        real = e > FLAT * len(self.values) * max(self.values[0], 0)
        return self.vectors[:, :k] / np.sqrt(np.where(real, e, 1)), real

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - sum) ** 2, exact."""
        y = x - self.whole
        top = float(self.n) * (np.abs(y).max(initial=0) + 1.0)
        if top * top * y.shape[1] < 2.0**63:
            z = self.n * y - self.rest
            return (z * z).sum(1)
        out = [sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(row, self.rest, strict=True)) for row in y]
        if max(out) >= 1 << 63:
            raise OverflowError("deviation does not fit in a long")
        return np.array(out, np.int64)


def whole_numbers(v: np.ndarray, scale: int, shift: int) -> np.ndarray:
    c = np.floor(np.float64(scale) * v.astype(np.float64))
    if len(c) and not np.abs(c).max() < 2.0**52:
        raise OverflowError("a component is beyond 2**52 / scale")
    return c.astype(np.int64) + shift


def usable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & ok).select(
        F.col(id_col).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if top and top["d"] > MAX_DIMENSION:
        raise ValueError(f"vectors of over {MAX_DIMENSION} components")
    return rows.filter(F.size("v") == (top["d"] if top else 0))


def totals(points: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = low = n = 0  # sums of the halves of x: neither overflows below 2**36 rows
        for b in batches:
            if b.num_rows:
                x = whole_numbers(matrix(b.column(0)), scale, shift)
                high, low, n = high + (x >> 26).sum(0), low + (x & (2**26 - 1)).sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high]), pa.array([low])], names=["n", "high", "low"])

    parts = points.select("v").mapInArrow(run, "n long, high array<long>, low array<long>")
    rows = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "x")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("x.high").cast("decimal(38,0)")).alias("high"),
        F.sum(F.col("x.low").cast("decimal(38,0)")).alias("low")).orderBy("i").collect()
    return (rows[0]["n"], [(int(r["high"]) << 26) + int(r["low"]) for r in rows]) if rows else (0, [])


class Sum:
    """A running sum of arrays that carries what rounding loses."""

    def __init__(self):
        self.value, self.lost = None, None

    def add(self, x: np.ndarray) -> None:
        if self.value is None:
            self.value, self.lost = np.array(x, np.float64), np.zeros_like(x)
            return
        total = self.value + x
        back = total - self.value
        self.lost += (self.value - (total - back)) + (x - back)
        self.value = total

    @property
    def total(self) -> np.ndarray:
        return self.value + self.lost


def gram(points: DataFrame, rows_of: Callable[[np.ndarray], np.ndarray], scale: int, shift: int, width: int) -> np.ndarray:
    """Z'Z over all rows, Z = rows_of(x) with ``width`` columns: per task, then by row of the matrix."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sum()
        for b in batches:
            if b.num_rows:
                z = rows_of(whole_numbers(matrix(b.column(0)), scale, shift))
                total.add(z.T @ z)
        if total.value is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total.total), pa.list_(pa.float64()))], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Sum] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                sums.setdefault(i, Sum()).add(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.total for s in sums.values()], pa.list_(pa.float64()))], names=["i", "row"])

    schema = "i long, row array<double>"
    parts = points.select("v").mapInArrow(products, schema).repartition(min(width, partitions_for(points)), "i")
    out = np.zeros((width, width))
    for r in parts.mapInArrow(added, schema).collect():  # width rows of width numbers
        out[r["i"]] = r["row"]
    return (out + out.T) / 2


def fit(points: DataFrame, k: int, scale: int, shift: int) -> Fit | None:
    n, sums = totals(points, scale, shift)
    if not n:
        return None
    d = len(sums)
    rough = Fit(n, sums, np.zeros(d), np.eye(d), 0.0, scale, shift)
    cov = gram(points, rough.centred, scale, shift, d) / n
    values, vectors = refined(cov)
    model = Fit(n, sums, values, vectors, float(np.trace(cov)), scale, shift)
    w, real = model.weights(k)
    if real.any():
        ones = lambda x: np.hstack([model.centred(x) @ w, np.ones((len(x), 1))])
        g = gram(points, ones, scale, shift, w.shape[1] + 1) / n
        off = (g[:-1, :-1] - np.outer(g[:-1, -1], g[:-1, -1]) - np.eye(w.shape[1]))[np.ix_(real, real)]
        model.identity_error = float(np.abs(off).max())
    return model


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1_024,
           shift: int = 100_000) -> DataFrame:
    """One row per vector and component (``OUT``), the components numbered from 1 by falling eigenvalue."""
    spark = df.sparkSession
    python_workers(spark)
    schema = OUT.format(id=df.schema[id_col].dataType.simpleString())
    points = usable(df, id_col, vector)
    model = fit(points, k, scale, shift)
    if model is None:
        return spark.createDataFrame([], schema)
    w, real = model.weights(k)
    number = w.shape[1]
    share = [float(e) / model.trace if model.trace else None for e in model.values[:number]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = whole_numbers(matrix(b.column(1)), scale, shift)
            z = model.centred(x) @ w
            whitened = pa.array(z.ravel(), pa.float64(), mask=np.tile(~real, n))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(np.arange(n), number))),
                pa.array(np.tile(np.arange(1, number + 1, dtype=np.int32), n)),
                pa.array(np.full(n * number, model.n, np.int64)), pa.array(np.repeat(model.deviation(x), number)), whitened,
                pa.array(share * n, pa.float64()), pa.array(np.full(n * number, model.identity_error))], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return points.mapInArrow(run, schema)
