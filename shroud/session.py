"""Spark session helpers.

The library never builds its own session inside operators; callers pass one in.
``local_session`` is for tests, the bench and the examples: it sets the knobs a
local run needs and, only when the cluster has not named one, a checkpoint
folder in a fresh scratch directory.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "shroud") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole documents go to the recursive splitter: keep Arrow batches modest
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", os.environ.get("SHROUD_ARROW_BATCH", "2000"))
        .config("spark.driver.memory", os.environ.get("SHROUD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, object
    store) and is used as is. Only an unconfigured session in local mode (tests)
    gets a fresh scratch folder; on a cluster that is an error, because each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="shroud-ckpt-", dir=os.environ.get("SHROUD_SCRATCH", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (as ``--py-files`` would).

    Needed only by the steps that run Python in tasks (the recursive splitter,
    caller-supplied detectors, file extractors). The zip is built in memory
    and written through the Hadoop file system into the shared checkpoint
    folder, from where Spark distributes it. Done once per context.
    """
    import hashlib
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_shroud_shipped", False):
        return
    import shroud

    root = os.path.dirname(os.path.abspath(shroud.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for dirpath, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    data = buf.getvalue()
    digest = hashlib.sha1(data).hexdigest()[:16]
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/pyfiles/shroud-{digest}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    sc.addPyFile(fs.makeQualified(path).toString())
    sc._shroud_shipped = True
