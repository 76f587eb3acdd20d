"""The upload envelope and its unpacking.

An envelope row is ``file STRUCT<id, filename, meta STRUCT<content_type,
size>, data STRUCT<content>>``, the shape a document service hands over.
``from_envelope`` keeps well-formed rows as cleaned documents and routes the
rest to a rejects DataFrame with a reason; one bad row never fails the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions.text import clean_text

ENVELOPE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField(
            "meta",
            T.StructType([T.StructField("content_type", T.StringType()), T.StructField("size", T.LongType())]),
        ),
        T.StructField("data", T.StructType([T.StructField("content", T.StringType())])),
    ]
)
ENVELOPE_ROW = T.StructType([T.StructField("file", ENVELOPE)])


def envelope_col(id_: Column, filename: Column, content_type: Column, size: Column, content: Column) -> Column:
    """The nested envelope struct."""
    return F.struct(
        id_.cast("string").alias("id"),
        filename.alias("filename"),
        F.struct(content_type.alias("content_type"), size.cast("long").alias("size")).alias("meta"),
        F.struct(content.alias("content")).alias("data"),
    )


def documents_as_envelopes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Envelopes for a documents table (file name ``doc-<id>.txt``, plain text, size in UTF-8 bytes)."""
    did = F.col(id_col).cast("string")
    return docs.select(
        envelope_col(did, F.concat(F.lit("doc-"), did, F.lit(".txt")), F.lit("text/plain"),
                     F.octet_length(F.col(text_col)), F.col(text_col)).alias("file")
    )


def _reject_reason(f: Column) -> Column:
    return (
        F.when(f.isNull(), F.lit("missing file"))
        .when(F.coalesce(F.length(f["data"]["content"]), F.lit(0)) == 0, F.lit("missing content"))
        .when(f["id"].isNull(), F.lit("missing id"))
        .when(f["filename"].isNull(), F.lit("missing filename"))
        .when(f["meta"]["content_type"].isNull(), F.lit("missing content type"))
    )


def from_envelope(envelopes: DataFrame, clean: bool = True, unique_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Envelopes -> (documents ``id, name, type, content``, rejects ``file, reason``).

    Content is cleaned on load (C1-C9) unless ``clean`` is off. With
    ``unique_ids`` a repeated id keeps its last envelope in arrival order and
    the earlier ones go to the rejects (Q17).
    """
    f = F.col("file")
    tagged = envelopes.select(f, _reject_reason(f).alias("reason"))
    if unique_ids:
        tagged = _mark_superseded(tagged)
    content = f["data"]["content"]
    docs = tagged.where(F.col("reason").isNull()).select(
        f["id"].alias("id"),
        f["filename"].alias("name"),
        f["meta"]["content_type"].alias("type"),
        (clean_text(content) if clean else content).alias("content"),
    )
    rejects = tagged.where(F.col("reason").isNotNull()).select(F.to_json(f).alias("file"), "reason")
    return docs, rejects


def from_envelope_json(lines: DataFrame, value_col: str = "value", clean: bool = True) -> tuple[DataFrame, DataFrame]:
    """S12 from JSON text rows (one envelope object per row); malformed JSON is rejected."""
    parsed = lines.select(F.from_json(F.col(value_col), ENVELOPE_ROW)["file"].alias("file"))
    return from_envelope(parsed, clean)


def _mark_superseded(tagged: DataFrame) -> DataFrame:
    """Give every envelope but the last of its id (arrival order) the reason 'superseded'.

    The last arrival per id is found with a partial ``max`` aggregate (a hot
    id is combined map-side), then joined back on the id.
    """
    seq = tagged.withColumn("_seq", F.monotonically_increasing_id())
    last = (seq.where(F.col("reason").isNull()).groupBy(F.col("file")["id"].alias("_id"))
            .agg(F.max("_seq").alias("_last")))
    joined = seq.join(last, F.col("file")["id"] == F.col("_id"), "left")
    reason = F.when(F.col("reason").isNull() & F.col("_last").isNotNull() & (F.col("_seq") != F.col("_last")),
                    F.lit("superseded")).otherwise(F.col("reason"))
    return joined.select("file", reason.alias("reason"))


def latest_per_id(docs: DataFrame, order_col: str) -> DataFrame:
    """Q17: one document per id, the last by ``order_col`` (ingest order); a hot id aggregates partially."""
    cols = [c for c in docs.columns if c != "id"]
    best = docs.groupBy("id").agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("d"))
    return best.select("id", *[F.col("d")[c].alias(c) for c in cols])
