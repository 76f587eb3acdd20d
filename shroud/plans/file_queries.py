"""Registered queries over real files: folders written from the documents, then listed and read.

Writing the folder only makes files to read; nothing of what the queries test is
taken from it. The folders lie under the shared checkpoint folder and are removed
when the (small) result has been written: files by the tasks, as the driver alone
would take them one after the other.
"""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from typing import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.operators.partitioning import drop_folder, save_table, spread
from shroud.session import ensure_checkpoint_dir, ship_package
from shroud.sources.files import basename, extract_documents, list_files, qualified
from shroud.sources.walk import local_path, remove_files

# How names begin and end in the written folder, by document number.
BEGINNINGS = ["_", ".", "", "", ""]
ENDINGS = [".txt", ".md", ".TXT", ".pdf", "", ".html"]
#: Listed kinds, and the size limit in MB (10,485 bytes).
LISTED, LIMIT_MB = ["txt", "MD", ".pdf"], 0.01
#: Rows of whole texts that a writing task turns into Python objects at once.
WRITE_ROWS = 500


def write_file(path: str, data: bytes, made: set[str]) -> None:
    """``made`` are the folders that the caller has made before."""
    folder = os.path.dirname(path)
    local = local_path(path)
    if local is not None:
        if folder not in made:
            os.makedirs(os.path.dirname(local), exist_ok=True)
            made.add(folder)
        with open(local, "wb") as f:
            f.write(data)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if folder not in made:
        store.create_dir(os.path.dirname(inner))
        made.add(folder)
    with store.open_output_stream(inner) as f:
        f.write(data)


def write_folder(rows: DataFrame, make) -> str:
    """A folder with one file for each row of ``rows`` (name, then what ``make`` turns into bytes)."""
    spark = rows.sparkSession
    ship_package(spark)
    base = qualified(spark, os.path.join(ensure_checkpoint_dir(spark), f"files-{uuid.uuid4().hex}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for b in batches:
            for lo in range(0, b.num_rows, WRITE_ROWS):
                for name, *parts in zip(*[c.to_pylist() for c in b.slice(lo, WRITE_ROWS).columns], strict=True):
                    write_file(f"{base}/{name}", make(*parts), made)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    spread(rows).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return base


def result(df: DataFrame, base: str, rows: DataFrame | None = None) -> DataFrame:
    """``df`` written, and the folder that it read removed; the files of ``rows`` (name) by the tasks, others by the driver."""
    out = save_table(df, prefix="file-results")
    if rows is not None:
        remove_files(spread(rows.select("name")), base)
    drop_folder(df.sparkSession, base)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def q_file_load(spark, sf_dir):
    """Names that begin with _ or a dot, mixed endings, a size limit, invalid bytes, both line ends."""
    pick = lambda options: F.element_at(F.array(*map(F.lit, options)), (F.col("doc_id") % len(options) + 1).cast("int"))
    folder = F.concat_ws("/", F.coalesce("lang", F.lit("-")), F.coalesce("source", F.lit("-")))
    name = F.concat(folder, F.lit("/"), pick(BEGINNINGS), F.lit("doc-"), F.col("doc_id").cast("string"), pick(ENDINGS))
    text = F.coalesce("text", F.lit(""))
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text)
    rows = documents(spark, sf_dir).select(name.alias("name"), text.alias("text"), (F.col("doc_id") % 7 == 0).alias("bad"))
    base = write_folder(rows, lambda text, bad: text.encode() + (b"\xff" if bad else b""))
    files = list_files(spark, base, recursive=True, extensions=LISTED, max_mb=LIMIT_MB)
    ok, rejects = extract_documents(files)
    loaded = ok.select("filename", "file_id", "length", F.sha2("text", 256).alias("text_sha256"), F.lit(None).cast("string").alias("error"))
    failed = rejects.select(basename(F.col("path")).alias("filename"), F.lit(None).cast("string").alias("file_id"),
                            F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("text_sha256"), "error")
    return result(loaded.unionByName(failed), base, rows)


def packed_docx(text: str) -> bytes:
    """A package with a paragraph for each line."""
    run = lambda line: "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in line.split("\t"))
    body = "".join(f"<w:p><w:pPr><w:jc/></w:pPr><w:r>{run(line)}</w:r></w:p>" for line in text.split("\n"))
    return _packed("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>')


def packed_odt(text: str) -> bytes:
    blanks = lambda x: escape(x).replace(" ", "<text:s/>")
    line = lambda x: "<text:tab/>".join(map(blanks, x.split("\t")))
    body = "".join(f"<text:p>{line(x)}</text:p>" for x in text.split("\n"))
    return _packed("content.xml", f'<office:body xmlns:office="urn:o" xmlns:text="urn:t">{body}</office:body>')


def _packed(member: str, xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(member, xml)
    return out.getvalue()


def q_file_containers(spark, sf_dir):
    """Every document as a .docx or .odt package, flat folder; texts as read back."""
    kind = F.when(F.col("doc_id") % 2 == 0, ".docx").otherwise(".odt")
    rows = documents(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), kind).alias("name"), F.coalesce("text", F.lit("")).alias("text"),
                                           (F.col("doc_id") % 2 == 0).alias("docx"))
    base = write_folder(rows, lambda text, docx: packed_docx(text) if docx else packed_odt(text))
    ok, _ = extract_documents(list_files(spark, base, id_mode="hash"))
    return result(ok.select("filename", "ext", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")), base, rows)


FILE_QUERIES = {"file_load": q_file_load, "file_containers": q_file_containers}


def _pick(options: list[str]) -> str:
    listed = ", ".join(f"'{x}'" for x in options)
    return f"([{listed}])[doc_id % {len(options)} + 1]"


FILE_ORACLE = {
    "file_load": f"""
    WITH f AS (
      SELECT coalesce(lang, '-') || '/' || coalesce(source, '-') || '/' AS folder, {_pick(BEGINNINGS)} || 'doc-' || doc_id || {_pick(ENDINGS)} AS filename,
             lower({_pick(ENDINGS)}) AS ext, doc_id % 7 = 0 AS bad,
             CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), chr(10), chr(13) || chr(10)) ELSE coalesce(text, '') END AS written
      FROM documents),
    l AS (
      SELECT *, strlen(written) + bad::INTEGER AS length FROM f
      WHERE ext IN ('.txt', '.md', '.pdf') AND strlen(written) + bad::INTEGER <= {LIMIT_MB} * 1024 * 1024),
    n AS (SELECT *, CAST(row_number() OVER (ORDER BY folder || filename) - 1 AS VARCHAR) AS file_id FROM l),
    e AS (SELECT *, CASE WHEN ext = '.pdf' THEN 'Unsupported file format: .pdf' WHEN bad THEN 'invalid UTF-8' END AS error FROM n)
    SELECT filename, CASE WHEN error IS NULL THEN file_id END AS file_id, CASE WHEN error IS NULL THEN length END AS length,
           CASE WHEN error IS NULL THEN sha256(replace(replace(written, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS text_sha256,
           error FROM e""",
    "file_containers": """
    SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.odt' END AS filename, CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.odt' END AS ext,
           length(coalesce(text, '')) AS n_chars, sha256(coalesce(text, '')) AS text_sha256
    FROM documents""",
}
