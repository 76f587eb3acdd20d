"""Structured Streaming front end: envelopes arriving as files -> findings per micro-batch.

The reference serves requests that each carry a batch of documents. Here the
documents arrive as JSON envelope files in a directory (one envelope object
per line); every micro-batch runs the same batch plan (unpack, clean, chunk,
detect in rounds, de-duplicate) inside ``foreachBatch`` and writes its
findings and rejects under ``batch_id=N``. Documents are independent and
arrive whole, so per-batch processing gives the same findings as one big
batch. Writes overwrite their own ``batch_id`` folder, so a batch replayed
after a failure (the query's checkpoint tracks progress) rewrites the same
output instead of duplicating it. A document id sent again later replaces
its earlier findings when read through :func:`latest_findings`; within one
batch the last envelope of an id wins.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shroud.operators.findings import findings
from shroud.plans.scan import detect_documents
from shroud.session import ensure_checkpoint_dir
from shroud.sources.envelope import ENVELOPE_ROW, from_envelope


def envelope_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ENVELOPE_ROW)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(source_dir)


def process_batch(batch: DataFrame, batch_id: int, output_dir: str, **options) -> None:
    """One micro-batch: envelopes -> findings and rejects under ``batch_id=<n>``."""
    batch = batch.persist()  # read for the detections, the document list and the rejects
    try:
        docs, rejects = from_envelope(batch, unique_ids=True)
        prepared = docs.select(F.col("id").alias("doc_id"), F.col("content").alias("text"))
        result = detect_documents(prepared, clean=False, **options).drop_chunks()
        out = findings(result.detections).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").parquet(os.path.join(output_dir, "findings", f"batch_id={batch_id}"))
        docs.select("id").distinct().write.mode("overwrite").parquet(
            os.path.join(output_dir, "documents", f"batch_id={batch_id}"))
        rejects.write.mode("overwrite").parquet(os.path.join(output_dir, "rejects", f"batch_id={batch_id}"))
    finally:
        batch.unpersist()


def detect_stream(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_dir: str | None = None,
                  available_now: bool = False, processing_time: str | None = None,
                  max_files_per_trigger: int | None = None, **options) -> StreamingQuery:
    """Start the streaming detection query. ``options`` go to :func:`detect_documents`."""
    checkpoint_dir = checkpoint_dir or os.path.join(ensure_checkpoint_dir(spark), "detect-stream")
    writer = (
        envelope_stream(spark, source_dir, max_files_per_trigger)
        .writeStream.foreachBatch(lambda df, bid: process_batch(df, bid, output_dir, **options))
        .option("checkpointLocation", checkpoint_dir)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def latest_findings(spark: SparkSession, output_dir: str) -> DataFrame:
    """Findings with a document's later batches replacing earlier ones (last write wins, Q17).

    Every batch's findings carry ``batch_id``; a document id's findings come
    from its highest batch. Resolved when reading: one partial ``max`` per id
    and a semi-join, no streaming state. A document whose latest batch found
    nothing is read from its documents list, so its older findings are dropped too.
    """
    found = spark.read.parquet(os.path.join(output_dir, "findings"))
    seen = spark.read.parquet(os.path.join(output_dir, "documents"))
    latest = seen.groupBy("id").agg(F.max("batch_id").alias("batch_id"))
    return found.join(latest, ["id", "batch_id"], "left_semi")
