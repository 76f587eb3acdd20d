"""Partitioning and table helpers shared by the plans.

``spread`` rebalances only an under-split scan (fewer partitions than the
cluster has cores, e.g. a small file with one row group); a large input
already has enough splits and is left alone. ``save_table`` cuts lineage with
plain files in the shared checkpoint folder, and ``drop_table`` removes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    n = max(cores, shuffle_partitions(df))
    return df.repartition(n, *keys) if keys else df.repartition(n)


def _table_path(df: DataFrame, prefix: str) -> tuple[str, str]:
    import os
    import uuid

    from shroud.session import ensure_checkpoint_dir

    name = f"{prefix}_{uuid.uuid4().hex}"
    return name, os.path.join(ensure_checkpoint_dir(df.sparkSession), "tables", name)


def save_table(df: DataFrame, prefix: str = "shroud") -> DataFrame:
    """Write ``df`` as plain parquet in the shared checkpoint folder and read it back (cuts lineage)."""
    _, path = _table_path(df, prefix)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that :func:`save_table` wrote (or unpersist a persisted one)."""
    df.unpersist()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/tables/" in f}:
        drop_folder(df.sparkSession, folder)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
