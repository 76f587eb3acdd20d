"""Shared by the vector searches: valid rows, blocks of bounded size, and the merge of per-block results."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, no null or non-finite component, and the
    most frequent number of components (the smaller on a tie)."""
    ok = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ok).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (top["n"] if top else 0))


def once_per_id(queries: DataFrame) -> DataFrame:
    """Queries that repeat an id count once, with the least vector."""
    return queries.groupBy("vec_id").agg(F.min("v").alias("v"))


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a 2-dimensional array."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.empty((0, 0))


def vector_column(x: np.ndarray) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(x, np.float64).ravel()))


def best(score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    return np.lexsort((vec_id, -score))[:k]


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query over all blocks."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
