"""Grouping, combining and post-processing of detected items.

Everything stays in row form keyed by ``doc_id`` with the order key
``(round, chunk_index, item_pos)``; nothing collects a whole document's items
into one array on the hot path. De-duplication groups on ``(doc_id, key)``,
so a document with very many items spreads over many groups, and ``min_by``
aggregates partially before the shuffle. The nested ``{id, pii[]}`` shape is
produced only at the sink (:func:`findings_nested`).
"""

from __future__ import annotations

import json
import uuid
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shroud.functions.payload import ITEM_FIELDS, ITEMS, fenced, items_json, parse_items, strip_fence
from shroud.session import ship_package

ORDER = ("round", "chunk_index", "item_pos")
MASK_MARK = "****"


def payloads(detections: DataFrame) -> DataFrame:
    """One JSON payload per productive (doc, round, chunk), items in order.

    The group is one chunk, so its size is bounded by the chunk length.
    """
    grouped = detections.groupBy("doc_id", "round", "chunk_index").agg(
        F.array_sort(F.collect_list(F.struct("item_pos", *ITEM_FIELDS))).alias("_items"),
    )
    items = F.transform(F.col("_items"), lambda x: F.struct(*[x[f].alias(f) for f in ITEM_FIELDS]))
    return grouped.select("doc_id", "round", "chunk_index", F.size("_items").alias("n_items"),
                          items_json(items).alias("payload"))


def combine_payloads(payload_rows: DataFrame, require_fence: bool = False) -> DataFrame:
    """Parse every payload, skip unparsable ones, and merge them per document.

    The merged list of a document is its payloads' items in (round, chunk,
    position) order; returned as rows carrying that order key.
    """
    parsed = payload_rows.select(
        "doc_id", "round", "chunk_index", parse_items(strip_fence(F.col("payload"), require_fence)).alias("items")
    ).where(F.col("items").isNotNull())
    rows = parsed.select("doc_id", "round", "chunk_index", F.posexplode("items").alias("item_pos", "item"))
    return rows.select("doc_id", "round", "chunk_index", F.col("item_pos").cast("long").alias("item_pos"),
                       *[F.col("item")[f].alias(f) for f in ITEM_FIELDS])


# Own wording: instruction for merging a document's answers (G3). "{text}" is replaced by the list.
MERGE_TEMPLATE = (
    "The list below holds one JSON array of personal data items per line. Answer with one JSON array that "
    "holds all objects of all lines, inside a ```json fence.\n\n{text}\n"
)
#: Characters of a document's list that go to the merging function at once.
MERGE_CHARS = 100_000


def combine_with(payload_rows: DataFrame, merge: Callable[[str], str], template: str = MERGE_TEMPLATE,
                 max_chars: int = MERGE_CHARS) -> tuple[DataFrame, DataFrame]:
    """A caller's function (for instance a model client) merges each document's payloads.

    Returns ``(doc_id, item_pos, text, category, type, justification)`` and the
    rejects ``(doc_id, reason)``. Payloads that do not parse are skipped; the
    others of a document, in (round, chunk) order, become one list, a line
    ``- array`` each, which the function answers with one array, fenced or not.
    Rows reach the reducer sorted, so it holds one list of at most ``max_chars``
    (or one longer payload) at a time: a longer list is merged in parts, in
    order. A document whose answer fails is a reject and no other is touched.
    Both results call the function, so write the one that is needed first.
    """
    ship_package(payload_rows.sparkSession)
    good = parse_items(strip_fence(F.col("payload"), False))
    lists = payload_rows.select("doc_id", "round", "chunk_index", items_json(good).alias("payload")).where(
        "payload is not null and doc_id is not null and doc_id <> ''")
    ordered = lists.repartition("doc_id").sortWithinPartitions("doc_id", "round", "chunk_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(doc_id, part, lines):
            try:
                return doc_id, part, merge(template.replace("{text}", "\n".join(lines))), None
            except Exception as exc:  # one document's failure stays its own
                return doc_id, part, None, f"{type(exc).__name__}: {exc}"

        doc, part, lines, size = None, 0, [], 0
        for b in batches:
            rows = []
            for doc_id, payload in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if lines and (doc_id != doc or size + len(payload) > max_chars):
                    rows.append(answer(doc, part, lines))
                    part, lines, size = part + 1, [], 0
                if doc_id != doc:
                    doc, part = doc_id, 0
                lines.append(f"- {payload}")
                size += len(payload)
            yield _answers(rows)
        if lines:
            yield _answers([answer(doc, part, lines)])

    answers = ordered.mapInArrow(run, "doc_id string, part int, answer string, error string")
    parsed = answers.withColumn("items", parse_items(strip_fence(F.col("answer"), False)))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("items").isNull(), "no array of items")
    rejects = parsed.select("doc_id", reason.alias("reason")).where("reason is not null").groupBy("doc_id").agg(F.min("reason").alias("reason"))
    failed = F.max(F.col("items").isNull()).over(Window.partitionBy("doc_id"))
    before = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = parsed.withColumn("failed", failed).withColumn("ahead", F.coalesce(F.sum(F.size("items")).over(before), F.lit(0)))
    rows = placed.where("not failed").select("doc_id", "ahead", F.posexplode("items").alias("p", "item"))
    return rows.select("doc_id", (F.col("ahead") + F.col("p")).cast("long").alias("item_pos"), *[F.col("item")[f].alias(f) for f in ITEM_FIELDS]), rejects


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "part", "answer", "error"])


def dedupe_items(detections: DataFrame) -> DataFrame:
    """First occurrence per (doc, text + '_' + category); masked texts dropped.

    The key is the joined string (so ('a_b','c') and ('a','b_c') collide, as
    in the reference); missing fields count as ''. Empty texts are kept.
    """
    key = F.concat(F.coalesce("text", F.lit("")), F.lit("_"), F.coalesce("category", F.lit("")))
    unmasked = detections.where(~F.coalesce(F.col("text"), F.lit("")).contains(MASK_MARK))
    order = F.struct(*ORDER)
    firsts = unmasked.groupBy("doc_id", key.alias("_key")).agg(
        F.min_by(F.struct(*ORDER, *ITEM_FIELDS), order).alias("first")
    )
    return firsts.select(F.col("doc_id").alias("id"), *[F.col("first")[c].alias(c) for c in ORDER + ITEM_FIELDS])


def findings(detections: DataFrame) -> DataFrame:
    """P2-P4 in row form: ``id, round, chunk_index, item_pos, text, category, type, justification``."""
    return dedupe_items(detections)


def findings_nested(detections: DataFrame) -> DataFrame:
    """P4 sink shape: one row per document with a payload, ``id, pii ARRAY<item>`` in order.

    Documents whose items were all masked keep ``pii = []``. The array holds
    one entry per distinct (text, category) of the document.
    """
    rows = dedupe_items(detections)
    arrays = rows.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct(*ORDER, *ITEM_FIELDS))).alias("_pii")
    )
    docs = detections.select(F.col("doc_id").alias("id")).distinct()
    out = docs.join(arrays, "id", "left")
    pii = F.transform(F.coalesce(F.col("_pii"), F.array()), lambda x: F.struct(*[x[f].alias(f) for f in ITEM_FIELDS]))
    return out.select("id", pii.cast(ITEMS).alias("pii"))


def to_envelope_json(nested: DataFrame) -> DataFrame:
    """The printed response form, one JSON object per document."""
    return nested.select(F.to_json(F.struct("id", "pii")).alias("value"))


def write_nested(detections: DataFrame, path: str) -> int:
    """JSON lines ``{"id": .., "pii": [..]}``, one per document with a payload; the number of documents.

    Items reach a task sorted (a sort that spills) and go into the line as they
    come, so no task holds a document's whole list, however long. Documents whose
    items were all masked get ``"pii": []``; null fields are left out. A task
    writes under a name of its own and renames the whole file at its end, so a
    repeated task replaces the same file. Tasks must reach ``path`` (a mounted
    folder, or a store of ``pyarrow.fs``).
    """
    from shroud.sources.files import qualified

    spark = detections.sparkSession
    ship_package(spark)
    base = qualified(spark, path)
    items = dedupe_items(detections)
    documents = detections.select(F.col("doc_id").alias("id")).distinct()
    rows = items.unionByName(documents.withColumns({c: F.lit(None).cast(items.schema[c].dataType) for c in (*ORDER, *ITEM_FIELDS)}))
    ordered = rows.repartition("id").sortWithinPartitions(F.col("id"), *[F.col(c).asc_nulls_first() for c in ORDER]).select(
        F.spark_partition_id().alias("task"), "id", *ORDER, *ITEM_FIELDS)
    return ordered.mapInArrow(lambda batches: _write_lines(batches, base), "documents long").agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]


def _write_lines(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[pa.RecordBatch]:
    from shroud.sources.walk import FileWriter

    out, documents, fresh = None, 0, True
    for b in batches:
        for task, id_, round_, _, _, *fields in zip(*[c.to_pylist() for c in b.columns], strict=True):
            out = out or FileWriter(f"{base}/part-{task:05d}.json", uuid.uuid4().hex)
            if round_ is None:  # the row of the document itself comes before its items
                out.write(("]}\n" if documents else "") + '{"id": ' + json.dumps(id_, ensure_ascii=False) + ', "pii": [')
                documents, fresh = documents + 1, True
            else:
                item = {k: v for k, v in zip(ITEM_FIELDS, fields, strict=True) if v is not None}
                out.write(("" if fresh else ", ") + json.dumps(item, ensure_ascii=False))
                fresh = False
    if out:
        out.write("]}\n")
        out.close()
    yield pa.RecordBatch.from_arrays([pa.array([documents])], names=["documents"])


def write_findings(detections: DataFrame, path: str, fmt: str = "json", nested: bool = False) -> None:
    """Write the findings as rows (default) or nested ``{id, pii[]}`` per document.

    The nested form gathers one document's distinct items into one array;
    use it where documents hold a bounded number of distinct items.
    """
    out = findings_nested(detections) if nested else findings(detections)
    out.write.mode("overwrite").format(fmt).save(path)


def model_answers(detections: DataFrame) -> DataFrame:
    """A detector's fenced answer text per productive chunk (test and replay helper)."""
    return payloads(detections).withColumn("answer", fenced(F.col("payload")))
