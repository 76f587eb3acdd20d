"""Streaming front end: findings per micro-batch equal the batch run's."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from shroud.operators.findings import findings
from shroud.plans.scan import detect_documents
from shroud.sources.envelope import documents_as_envelopes
from shroud.streaming.ingest import detect_stream


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="shroud-stream-")
    src, out, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    # two arrival files
    env = documents_as_envelopes(docs)
    env.where(F.col("file.id").cast("int") % 2 == 0).coalesce(1).write.json(os.path.join(src, "a"))
    env.where(F.col("file.id").cast("int") % 2 == 1).coalesce(1).write.json(os.path.join(src, "b"))
    q = detect_stream(spark, os.path.join(src, "*"), out, ckpt, available_now=True, chunker="fixed")
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(out, "findings")).select("id", "text", "category")
    want = findings(detect_documents(docs, chunker="fixed").detections).select("id", "text", "category")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0


def test_later_batch_replaces_document(spark):
    from shroud.sources.envelope import envelope_col
    from shroud.streaming.ingest import latest_findings

    base = tempfile.mkdtemp(prefix="shroud-stream2-")
    src, out, ckpt = (os.path.join(base, x) for x in ("in", "out", "ckpt"))

    def envelope(rows, sub):
        df = spark.createDataFrame(rows, "id string, c string")
        df.select(envelope_col(F.col("id"), F.lit("a.txt"), F.lit("text/plain"), F.length("c"), F.col("c")).alias("file")) \
            .coalesce(1).write.json(os.path.join(src, sub))

    envelope([("1", "mail a@b.org"), ("2", "call +1 (555) 123-4567")], "a")
    q = detect_stream(spark, os.path.join(src, "*"), out, ckpt, available_now=True, chunker="fixed")
    q.awaitTermination(300)
    envelope([("1", "nothing here now")], "b")
    q = detect_stream(spark, os.path.join(src, "*"), out, ckpt, available_now=True, chunker="fixed")
    q.awaitTermination(300)
    got = sorted((r.id, r.text) for r in latest_findings(spark, out).collect())
    assert got == [("2", "+1 (555) 123-4567")]
