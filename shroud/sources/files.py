"""Document files on a (distributed) file system.

Directories are listed in tasks (``walk``), which sees every name. Filters, sort
and ids work on the listing alone; a file is opened where its row is, after all of
them, so no content is ever shuffled and no filtered file is read. Text kinds
are decoded, container formats (docx, odt: ``parts``) unpacked and other kinds
given to caller-supplied functions in one pass (``extract_documents``). Every
failure stays on its own row.
"""

from __future__ import annotations

import json
import logging
import mimetypes
import re
from typing import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shroud.operators.partitioning import save_table
from shroud.session import ship_package
from shroud.sources.envelope import envelope_col
from shroud.sources.parts import docx_text, odt_text
from shroud.sources.walk import dealt, reachable, read_bytes, read_files, walk

log = logging.getLogger(__name__)

# The document kinds the loader accepts and their MIME types.
KNOWN_TYPES = {
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".rtf": "application/rtf",
    ".odt": "application/vnd.oasis.opendocument.text",
}
TEXT_KINDS = (".txt", ".md")
CONTAINER_KINDS = (".docx", ".odt")
#: Characters of texts that a task holds before it hands them on, at most (a longer text is alone).
PIECE_CHARS = 2 << 20
SORT_KEYS = {"name": "path", "size": "length", "modified": "modificationTime"}


def mime_table() -> dict[str, str]:
    """Extension -> MIME type: the stdlib table plus the loader's own kinds."""
    table = dict(mimetypes.MimeTypes().types_map[1])
    table.update(KNOWN_TYPES)
    return table


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """``os.path.splitext`` extension of the base name (leading dots are not one), lower-cased."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = basename(path)
    ext = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext))


def normalize_extensions(exts: Iterable[str]) -> list[str]:
    """Lower-case, leading dot added."""
    return [e.lower() if e.startswith(".") else "." + e.lower() for e in exts]


def mime_type(path: Column, content: Column | None = None) -> Column:
    """By extension; else by magic bytes (PDF, ZIP named .docx); else octet-stream."""
    table = F.from_json(F.lit(json.dumps(mime_table(), sort_keys=True)), "map<string,string>")
    by_ext = F.try_element_at(table, extension(path))
    out = by_ext
    if content is not None:
        head = F.substring(content, 1, 512)
        by_magic = (
            F.when(F.startswith(head, F.lit(b"%PDF")), F.lit("application/pdf"))
            .when(F.startswith(head, F.lit(b"PK\x03\x04")) & path.endswith(".docx"), F.lit(KNOWN_TYPES[".docx"]))
        )
        out = F.coalesce(by_ext, by_magic)
    return F.coalesce(out, F.lit("application/octet-stream"))


def consecutive_ids(df: DataFrame, order: list[Column], name: str = "file_id", start: int = 0) -> DataFrame:
    """Consecutive positions in a global sort order without a single-partition window.

    One range shuffle; a sorted partition numbers its rows by itself, and its
    offset is the sum of the counts before it (one row per partition, at most
    ``spark.sql.shuffle.partitions``). The numbered rows are written first: the
    offsets and the result must see the same partitions, which a plan evaluated
    twice does not promise.
    """
    place = F.monotonically_increasing_id()  # partition << 33 | row within it
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)
    local = save_table(ordered, prefix="numbered").withColumn("_pid", F.shiftright("_place", 33))
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).alias("_off")
    )
    out = local.join(F.broadcast(offsets), "_pid")
    row = F.col("_place").bitwiseAND((1 << 33) - 1)
    return out.withColumn(name, F.coalesce("_off", F.lit(0)) + row + start).drop("_pid", "_place", "_off")


def qualified(spark: SparkSession, path: str) -> str:
    """The fully qualified form of ``path`` as the file index reports paths."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub(r"/+$", "", fs.makeQualified(p).toString())


def _is_directory(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def list_files(spark: SparkSession, path: str, recursive: bool = False, extensions: Iterable[str] | None = None,
               max_mb: float | None = None, sort_by: str = "name", names: Iterable[str] | None = None,
               with_content: bool = False, id_mode: str = "position", id_start: int = 0) -> DataFrame:
    """``path, filename, ext, length, modificationTime, file_id[, content]``.

    Flat mode opens ``path`` alone. A missing directory gives an empty result,
    not an error. ``id_mode='position'`` numbers the files from ``id_start`` (0,
    or 1 as the notebook variant does) in sort order; ``'hash'`` uses a path hash
    (no global sort). A store that only Spark reads (viewfs) is listed by its
    ``binaryFile`` source, which leaves out names that start with ``_`` or ``.``.
    """
    base = qualified(spark, path)
    columns = ["path", "length", "modificationTime"]
    own = reachable(base)
    if not _is_directory(spark, path):
        log.warning("Directory not found: %s", path)
        files = spark.createDataFrame([], "path string, length bigint, modificationTime timestamp")
    elif own:
        files = walk(spark, base, recursive)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(*columns)
        if not recursive:
            files = files.where(F.regexp_replace(F.col("path"), r"/[^/]*$", "") == F.lit(base))
    if max_mb:
        files = files.where(F.col("length") <= F.lit(float(max_mb) * 1024 * 1024))
    files = files.withColumn("filename", basename(F.col("path"))).withColumn("ext", extension(F.col("path")))
    if extensions:
        files = files.where(F.col("ext").isin(normalize_extensions(extensions)))
    if names:
        files = files.where(F.col("filename").isin(list(names)))
    files = files.select("path", "filename", "ext", "length", "modificationTime")
    if id_mode == "hash":
        files = files.withColumn("file_id", F.sha2(F.col("path"), 256))
    else:
        key = SORT_KEYS.get(sort_by, "path")
        order = [F.col(key), F.col("path")] if key != "path" else [F.col("path")]
        files = consecutive_ids(files, order, start=id_start).withColumn("file_id", F.col("file_id").cast("string"))
    if with_content:
        if own:
            return read_files(files)
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return files.join(found.select("path", "content"), "path")
    return files


# --- content extraction ----------------------------------------------------------------

DEFAULT_EXTRACTORS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".odt": odt_text}


def plain_text(data: bytes) -> str:
    """UTF-8 text with line ends as Python's text mode reads them; invalid bytes are an error."""
    return data.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")


def extract_documents(files: DataFrame, extractors: dict[str, Callable[[bytes], str]] | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """A listing -> (``path, ... , text``, rejects ``path, error``).

    One pass over the rows: a file is opened by its path, or taken from the
    column ``content`` where there is one. Text kinds decode (UTF-8; invalid
    bytes reject the file), other kinds go to ``extractors`` by lower-cased
    extension; files of unsupported kinds are not opened. Files that can't be read
    and extractor failures become rejects.
    """
    table: dict[str, Callable[[bytes], str]] = {**dict.fromkeys(TEXT_KINDS, plain_text), **DEFAULT_EXTRACTORS, **(extractors or {})}
    ship_package(files.sparkSession)
    held = "content" in files.columns
    keep = [c for c in files.columns if c != "content"]
    out_schema = files.select(*keep).schema.add("text", "string").add("error", "string")
    source = files if held else dealt(files)

    def one(ext: str, path: str, content: bytes | None) -> tuple[str | None, str | None]:
        if ext not in table:
            return None, f"Unsupported file format: {ext}"
        try:
            data = content if held else read_bytes(path)
            if data is None:
                return None, "not readable"
            return table[ext](data), None
        except UnicodeDecodeError:
            return None, "invalid UTF-8"
        except Exception as exc:  # one bad file must not fail the batch
            return None, f"{type(exc).__name__}: {exc}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            kept = [cols[c] for c in keep]
            lo, rows, size = 0, [], 0
            for i in range(b.num_rows):
                content = cols["content"][i].as_py() if held else None
                rows.append(one(cols["ext"][i].as_py(), cols["path"][i].as_py(), content))
                size += len(rows[-1][0] or "")
                if size >= PIECE_CHARS or i == b.num_rows - 1:
                    # the strings go before the piece is handed on, so none is held while the next ones are read
                    answers = [pa.array([r[k] for r in rows], pa.string()) for k in range(2)]
                    piece = [*[c.slice(lo, i + 1 - lo) for c in kept], *answers]
                    lo, rows, size = i + 1, [], 0
                    yield pa.RecordBatch.from_arrays(piece, names=[*keep, "text", "error"])
                    del answers, piece

    rows = source.mapInArrow(run, out_schema)
    return rows.where(F.col("error").isNull()).drop("error"), rows.where(F.col("error").isNotNull()).select("path", "error")


def files_to_envelopes(extracted: DataFrame) -> DataFrame:
    """S11 over extracted files: id = file_id (else the name without extension)."""
    fid = F.coalesce(F.col("file_id"), stem(F.col("path"))) if "file_id" in extracted.columns else stem(F.col("path"))
    return extracted.select(
        envelope_col(fid, F.col("filename"), mime_type(F.col("path")), F.col("length"), F.col("text")).alias("file")
    )


def load_directory(spark: SparkSession, path: str, recursive: bool = False, extensions: Iterable[str] | None = None,
                   max_mb: float | None = None, sort_by: str = "name", names: Iterable[str] | None = None,
                   extractors: dict[str, Callable[[bytes], str]] | None = None,
                   metrics: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """A directory -> (envelopes, rejects).

    When ``names`` are given and none of them is found the load stops with an
    error, as the reference client does (S6). Pass a dict as ``metrics`` to get
    ``loaded``/``rejected`` counters (``Observation``; read ``.get`` after an
    action on the returned frames).
    """
    files = list_files(spark, path, recursive, extensions, max_mb, sort_by, names,
                       with_content=not reachable(qualified(spark, path)))
    if names and files.isEmpty():
        raise ValueError(f"none of the requested files found in {path}")
    ok, rejects = extract_documents(files, extractors)
    if metrics is not None:
        from shroud.operators.metrics import observed

        ok, metrics["loaded"] = observed(ok, "loaded")
        rejects, metrics["rejected"] = observed(rejects, "rejected")
    return files_to_envelopes(ok), rejects
