"""Helpers shared by the operators: reading tables, tables in the shared folder, size-checked broadcast."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.session import ensure_checkpoint_dir, ship_package

#: Rows of whole texts in one Arrow batch at most.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def python_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and keep Arrow batches of whole texts small."""
    ship_package(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(setting)) > BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def shared_path(spark: SparkSession, prefix: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "llm", f"{prefix}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, prefix: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, prefix)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(df: DataFrame, own) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns for which ``own(name)`` holds under names of no meaning, and what names them back."""
    prefix = "set_aside_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    names = {c: f"{prefix}{i}" for i, c in enumerate(df.columns) if own(c)}
    return df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed({v: k for k, v in names.items()})


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint for ``df`` only when a count proves it small; ``df`` should be a written table."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def partitions_for(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str):
    """A key of a whole row's content; rows that are equal in ``cols`` share it."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in cols])


def sorted_groups(batches, keys: list[str]):
    """(columns, lo, hi) of every run of equal ``keys`` in batches sorted by them.

    A run may span batches; only the last, unfinished run is carried over.
    """
    import numpy as np
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None and held.num_rows:
            t = pa.concat_tables([held, t])
        t = t.combine_chunks()
        key = [np.asarray(t.column(k)) for k in keys]
        change = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in key:
            change |= k[1:] != k[:-1]
        cuts = np.flatnonzero(change) + 1
        if not len(cuts):
            held = t
            continue
        yield from _slices(t.slice(0, int(cuts[-1])), np.concatenate([[0], cuts]))
        held = t.slice(int(cuts[-1]))
    if held is not None and held.num_rows:
        yield from _slices(held, np.array([0, held.num_rows]))


def _slices(t, cuts):
    cols = {n: t.column(n).combine_chunks() for n in t.column_names}
    cols = {n: c.to_numpy(zero_copy_only=False) if c.type not in ("binary", "string") else c for n, c in cols.items()}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield cols, int(lo), int(hi)
