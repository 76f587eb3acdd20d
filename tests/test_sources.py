"""Sources: envelope unpacking (S11, S12) and files."""

import io
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from shroud.sources.envelope import ENVELOPE_ROW, from_envelope, from_envelope_json
from shroud.sources.files import extract_documents, list_files, load_directory, mime_type


def test_envelope_rejects(spark):
    rows = [
        ('{"file": {"id": "1", "filename": "a.txt", "meta": {"content_type": "text/plain", "size": 3}, "data": {"content": "a &amp; b"}}}',),
        ('{"nofile": 1}',),
        ('{"file": {"id": "2", "filename": "b.txt", "meta": {"content_type": "text/plain"}, "data": {"content": ""}}}',),
        ('{"file": {"filename": "c.txt", "meta": {"content_type": "text/plain"}, "data": {"content": "x"}}}',),
        ('{"file": {"id": "4", "meta": {"content_type": "text/plain"}, "data": {"content": "x"}}}',),
        ('{"file": {"id": "5", "filename": "e.txt", "meta": {}, "data": {"content": "x"}}}',),
        ("not json",),
    ]
    docs, rejects = from_envelope_json(spark.createDataFrame(rows, "value string"))
    got = [(r.id, r.name, r.type, r.content) for r in docs.collect()]
    assert got == [("1", "a.txt", "text/plain", "a & b")]
    reasons = sorted(r.reason for r in rejects.collect())
    assert reasons == sorted(["missing file", "missing content", "missing id", "missing filename",
                              "missing content type", "missing file"])


def _docx(text_paras):
    body = "".join(f'<w:p><w:r><w:t>{t}</w:t></w:r></w:p>' for t in text_paras)
    xml = ('<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
           f"<w:body>{body}</w:body></w:document>")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    return buf.getvalue()


def _corpus():
    d = tempfile.mkdtemp(prefix="shroud-files-")
    files = {
        "a.txt": "hello a\r\nline two".encode(),
        "b.MD": b"# title",
        "c.docx": _docx(["First para", "Second para"]),
        "d.pdf": b"%PDF-1.4 fake",
        "e.xyz": b"unknown",
        "g.txt": b"\xff\xfe bad utf8",
        "big.txt": b"x" * (2 * 1024 * 1024),
        "sub/f.txt": b"nested",
    }
    for name, data in files.items():
        p = os.path.join(d, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(data)
    return d


def test_listing_filters_sort_and_ids(spark):
    d = _corpus()
    flat = list_files(spark, d)
    assert sorted(r.filename for r in flat.collect()) == ["a.txt", "b.MD", "big.txt", "c.docx", "d.pdf", "e.xyz", "g.txt"]
    rec = list_files(spark, d, recursive=True, extensions=["TXT", ".md"], max_mb=1)
    rows = sorted(rec.collect(), key=lambda r: int(r.file_id))
    assert [r.filename for r in rows] == ["a.txt", "b.MD", "g.txt", "f.txt"]  # path order: sub/ after g.txt
    assert [r.file_id for r in rows] == ["0", "1", "2", "3"]
    by_size = sorted(list_files(spark, d, sort_by="size").collect(), key=lambda r: int(r.file_id))
    assert [r.length for r in by_size] == sorted(r.length for r in by_size)
    assert list_files(spark, os.path.join(d, "missing")).count() == 0
    names = list_files(spark, d, names=["a.txt"]).collect()
    assert [r.filename for r in names] == ["a.txt"]


def test_extract_and_mime(spark):
    d = _corpus()
    files = list_files(spark, d, with_content=True)
    ok, rejects = extract_documents(files)
    texts = {r.filename: r.text for r in ok.collect()}
    assert texts["a.txt"] == "hello a\nline two"
    assert texts["b.MD"] == "# title"
    assert texts["c.docx"] == "First para\nSecond para"
    errs = {os.path.basename(r.path): r.error for r in rejects.collect()}
    assert errs["e.xyz"] == "Unsupported file format: .xyz"
    assert errs["g.txt"] == "invalid UTF-8"
    assert "d.pdf" in errs  # no pdf extractor given
    mimes = {r.filename: r.m for r in files.select("filename", mime_type(F.col("path"), F.col("content")).alias("m")).collect()}
    assert mimes["c.docx"].endswith("wordprocessingml.document")
    assert mimes["b.MD"] == "text/markdown"
    assert mimes["e.xyz"] == "application/octet-stream"


def test_load_directory_with_pdf_extractor(spark):
    d = _corpus()
    metrics = {}
    env, rejects = load_directory(spark, d, extractors={".pdf": lambda b: b.decode("latin-1")}, metrics=metrics)
    docs, _ = from_envelope(env)
    got = {r.name: r.content for r in docs.collect()}
    n_rejects = rejects.count()
    assert metrics["loaded"].get["rows"] == len(got)
    assert metrics["rejected"].get["rows"] == n_rejects == 2  # e.xyz, g.txt
    assert got["d.pdf"] == "%PDF-1.4 fake"
    assert {r.type for r in docs.collect()} >= {"application/pdf", "text/plain"}


def test_duplicate_ids_keep_last(spark):
    from shroud.sources.envelope import envelope_col

    rows = [("7", "a.txt", "first"), ("8", "b.txt", "only"), ("7", "a.txt", "second")]
    df = spark.createDataFrame(rows, "id string, name string, c string").coalesce(1)
    env = df.select(envelope_col(F.col("id"), F.col("name"), F.lit("text/plain"), F.length("c"), F.col("c")).alias("file"))
    docs, rejects = from_envelope(env, unique_ids=True)
    assert sorted((r.id, r.content) for r in docs.collect()) == [("7", "second"), ("8", "only")]
    assert [r.reason for r in rejects.collect()] == ["superseded"]


def test_named_files_missing_abort(spark):
    import pytest

    d = _corpus()
    with pytest.raises(ValueError):
        load_directory(spark, d, names=["nope.txt"])


def test_consecutive_ids_across_partitions(spark):
    from shroud.sources.files import consecutive_ids

    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 3).alias("g")).repartition(7)
    out = consecutive_ids(df, [F.col("g"), F.col("k")], name="pos", start=1).collect()
    got = sorted((r.pos, r.g, r.k) for r in out)
    want = sorted(((r.g, r.k) for r in df.collect()))
    assert [p for p, _, _ in got] == list(range(1, 5001))
    assert [(g, k) for _, g, k in got] == want


def test_written_files_are_listed_in_order(spark, tmp_path):
    """Files that Spark writes: numbered 0.. in path order, all plain text, with the text they were written with."""
    from shroud.sources.envelope import from_envelope
    from shroud.sources.files import extract_documents, files_to_envelopes, list_files

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = f"{tmp_path}/corpus"
    docs.select("lang", "source", "text").repartition("lang", "source").write.partitionBy("lang", "source").text(out)
    files = list_files(spark, out, recursive=True, extensions=["txt"], with_content=True)
    ok, rejects = extract_documents(files)
    rows = from_envelope(files_to_envelopes(ok))[0].collect()
    listed = sorted((r.path, int(r.file_id)) for r in files.collect())
    assert [i for _, i in listed] == list(range(len(rows))) == sorted(int(r.id) for r in rows)
    assert {r.type for r in rows} == {"text/plain"} and rejects.count() == 0
    assert sum(len(r.text) for r in ok.collect()) == sum(len(r.text) + 1 for r in docs.collect())


def test_odt_keeps_text_in_order():
    import io
    import zipfile

    from shroud.sources.files import odt_text

    body = ("<d xmlns:t='urn:t'><t:h>Title</t:h><t:p>Call <t:span>John</t:span> Smith<t:tab/>at <t:a>a@b.org</t:a> now"
            "<t:line-break/>or<t:s t:c='2'/>later</t:p></d>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("content.xml", body)
    assert odt_text(data.getvalue()) == "Title\nCall John Smith\tat a@b.org now\nor  later"


def test_positions_over_several_partitions(spark):
    from pyspark.sql import functions as F

    from shroud.sources.files import consecutive_ids

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(0, 20_000, 1, 7).select(F.concat(F.lit("p"), F.xxhash64("id") % 5_000).alias("path"), "id")
        got = consecutive_ids(df, [F.col("path"), F.col("id")]).orderBy("file_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.file_id for r in got] == list(range(20_000))
    assert [(r.path, r.id) for r in got] == sorted((r.path, r.id) for r in got)
