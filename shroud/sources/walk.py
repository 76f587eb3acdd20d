"""Directories walked and files read inside tasks.

A listing sees every name: Spark's own file sources leave out names that start
with ``_`` or ``.``. A task descends from its directories until it has listed
``BUDGET`` entries, and hands the directories it has not opened to the next
round, where they are dealt over tasks again; a flat listing opens one directory
and nothing below it. Only paths, lengths and times leave a task.

Paths are those of Hadoop (``file:/dir/name``). Local and mounted folders are
read as such, other stores through ``pyarrow.fs``. A store that neither reaches
is listed by Spark's ``binaryFile`` source instead (see ``files.list_files``).
"""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.operators.partitioning import save_table, shuffle_partitions
from shroud.session import ship_package

#: Entries that one task lists before it hands its unopened directories on.
BUDGET = 20_000
ENTRY = "path string, length bigint, modificationTime timestamp, is_dir boolean"
#: Bytes of file contents in one Arrow batch, and in one task, at most (a larger file is alone).
BATCH_BYTES, TASK_BYTES = 32 << 20, 256 << 20


def local_path(path: str) -> str | None:
    """The operating system's name of a ``file:`` path; None for another scheme."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme and scheme.group(1) != "file":
        return None
    return re.sub(r"^file:(//)?(?=/)", "", path)


def entries(path: str) -> Iterator[tuple[str, int | None, datetime | None, bool]]:
    """(path, length, time, is a directory) of a directory's entries. Links to files count as files, links to
    directories are not followed, an entry that can't be looked at has no length."""
    base = path.rstrip("/")
    local = local_path(path)
    if local is not None:
        with os.scandir(local) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    yield f"{base}/{e.name}", None, None, True
                elif not e.is_dir():
                    try:
                        s = e.stat()
                        yield f"{base}/{e.name}", s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc), False
                    except OSError:
                        yield f"{base}/{e.name}", None, None, False
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    for e in store.get_file_info(fs.FileSelector(inner)):
        is_dir = e.type == fs.FileType.Directory
        yield f"{base}/{e.base_name}", None if is_dir else e.size, None if is_dir else e.mtime, is_dir


def read_bytes(path: str) -> bytes:
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as f:
            return f.read()
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_stream(inner) as f:
        return f.read()


def remove_files(names: DataFrame, base: str) -> None:
    """The files ``base/name`` removed, each task those of its rows; one that is not there (any more) is passed over."""
    ship_package(names.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                remove_file(f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], names=["n"])

    names.mapInArrow(run, "n long").count()


def remove_file(path: str) -> None:
    local = local_path(path)
    try:
        if local is not None:
            os.unlink(local)
            return
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.delete_file(inner)
    except FileNotFoundError:
        pass


class FileWriter:
    """Text into a file that is there whole under its name, or not at all."""

    def __init__(self, path: str, attempt: str):
        self.path, self.temporary, self.local = path, f"{path}.{attempt}.tmp", local_path(path)
        if self.local is not None:
            self.temporary = local_path(self.temporary)
            os.makedirs(os.path.dirname(self.local), exist_ok=True)
            self.stream = open(self.temporary, "wb", buffering=1 << 20)
            return
        from pyarrow import fs

        self.store, self.inner = fs.FileSystem.from_uri(path)
        self.store.create_dir(os.path.dirname(self.inner))
        self.stream = self.store.open_output_stream(f"{self.inner}.{attempt}.tmp", buffer_size=1 << 20)
        self.temporary = f"{self.inner}.{attempt}.tmp"

    def write(self, text: str) -> None:
        self.stream.write(text.encode("utf-8", "surrogatepass"))

    def close(self) -> None:
        self.stream.close()
        if self.local is not None:
            os.replace(self.temporary, self.local)
        else:
            self.store.move(self.temporary, self.inner)


def reachable(path: str) -> bool:
    """Whether tasks can open this store."""
    if local_path(path) is not None:
        return True
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, NotImplementedError):
        return False
    return True


def walk(spark: SparkSession, path: str, recursive: bool, budget: int = BUDGET) -> DataFrame:
    """(path, length, modificationTime) of the files in ``path`` (``recursive``: and below)."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting, rows, listed = b.column(0).to_pylist(), [], 0
            while waiting and listed < budget:
                for entry in entries(waiting.pop()):
                    listed += 1
                    if not entry[3]:
                        rows.append(entry)
                    elif recursive:
                        waiting.append(entry[0])
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
            yield _batch([*rows, *((d, None, None, True) for d in waiting)])

    level, found = spark.createDataFrame([(path,)], "path string"), None
    while True:
        listed = save_table(level.mapInArrow(run, ENTRY), prefix="listing")
        files = listed.where("not is_dir").drop("is_dir")
        found = files if found is None else found.unionByName(files)
        below = listed.where("is_dir").select("path")
        if not recursive or below.isEmpty():
            return found
        level = below.repartition(max(shuffle_partitions(below), spark.sparkContext.defaultParallelism), "path")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC"), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                      names=["path", "length", "modificationTime", "is_dir"])


def dealt(files: DataFrame) -> DataFrame:
    """A listing dealt over so many tasks that none reads much more than ``TASK_BYTES``; only its rows move."""
    total = files.agg(F.sum("length")).first()[0] or 0
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(cores, -(-total // TASK_BYTES)))


def read_files(files: DataFrame) -> DataFrame:
    """``files`` with ``content``, read where the row is; null where a file can't be read."""
    ship_package(files.sparkSession)
    names = files.columns
    at = names.index("path")
    schema = files.schema.add("content", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, held, size = 0, [], 0
            for i, path in enumerate(b.column(at).to_pylist()):
                try:
                    held.append(read_bytes(path))
                except OSError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(lo, i + 1 - lo)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    lo, held, size = i + 1, [], 0

    return dealt(files).mapInArrow(run, schema)
