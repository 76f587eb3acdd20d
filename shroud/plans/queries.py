"""Registered queries: one per operator group of the survey, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables in full (or what Spark derives from them)
and is paired, where SQL can say the same, with a DuckDB statement in
:func:`oracle_sql`. Computed columns carry the same names on both sides.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroud.functions.fold import casefold, fold
from shroud.functions.payload import FENCE_CLOSE, FENCE_OPEN, ITEM_FIELDS, ITEMS, fenced, parse_items, reject_reason, strip_fence
from shroud.functions.text import clean_text
from shroud.operators.chunk import chunk_documents, examinable
from shroud.operators.detect import (DEFAULT_RULES, MORE_RULES, detect_dictionary, detect_rules, detect_with,
                                     render_prompt, terms_table, with_checks)
from shroud.operators.findings import combine_payloads, combine_with, findings, model_answers, payloads, write_nested
from shroud.operators.mask import chunks_with_items, doc_items, mask_documents, merge_ranges_col, ranges_per_chunk
from shroud.operators.partitioning import save_table, spread
from shroud.plans.file_queries import FILE_QUERIES, result
from shroud.plans.scan import find_items, first_match_detector, rules_detector, scan_rounds
from shroud.session import ensure_checkpoint_dir
from shroud.sources.envelope import documents_as_envelopes, from_envelope
from shroud.sources.files import extract_documents, files_to_envelopes, list_files, mime_type, consecutive_ids, extension

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# --- shared building blocks ---------------------------------------------------------------------


def doc_texts(spark, sf_dir) -> DataFrame:
    """The documents in their scan partitions: row-local operators need no shuffle of the text."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"),
                                                           F.col("text").alias("content")))


def fixed_chunks(spark, sf_dir, tidy=True) -> DataFrame:
    chunks = chunk_documents(doc_texts(spark, sf_dir), method="fixed", tidy=tidy)
    return examinable(chunks) if tidy else chunks


def round0(spark, sf_dir) -> DataFrame:
    return detect_rules(fixed_chunks(spark, sf_dir), round_=0)


def mask_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks and their round-0 detections, written once because several branches read them."""
    chunks = save_table(fixed_chunks(spark, sf_dir), prefix="chunks")
    dets = save_table(detect_rules(chunks, round_=0), prefix="detections")
    return chunks, dets


# Gazetteer stand-in for the dictionary detector. The synthetic
# prose has no real names; these invented capitalised words occur in it.
DICTIONARY_TERMS = (
    ("Orre", "name", "direct", "Listed in the name dictionary."),
    ("Eriner", "name", "direct", "Listed in the name dictionary."),
    ("Nicht", "location data", "indirect", "Listed in the place dictionary."),
    ("Eauouon", "location data", "indirect", "Listed in the place dictionary."),
)


# --- queries ------------------------------------------------------------------------------------


def q_load_documents(spark, sf_dir):
    docs, _ = from_envelope(documents_as_envelopes(spread(table(spark, sf_dir, "documents"))))
    return docs


def q_clean_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages"))
    return pages.select("page_id", clean_text(F.col("html")).alias("content"))


def q_chunk_fixed(spark, sf_dir):
    return fixed_chunks(spark, sf_dir, tidy=False)


def q_chunk_tidy(spark, sf_dir):
    return fixed_chunks(spark, sf_dir, tidy=True)


def q_chunk_short(spark, sf_dir):
    chunks = fixed_chunks(spark, sf_dir, tidy=False)
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"),
                                        F.sum(F.length("content")).alias("n_chars"))


def q_chunk_recursive(spark, sf_dir):
    return chunk_documents(doc_texts(spark, sf_dir), method="recursive")


def q_detect_rules(spark, sf_dir):
    return round0(spark, sf_dir)


def q_detect_rules_pages(spark, sf_dir):
    pages = spread(table(spark, sf_dir, "pages")).select(F.col("page_id").cast("string").alias("doc_id"),
                                                         clean_text(F.col("html")).alias("content"))
    return detect_rules(examinable(chunk_documents(pages, method="fixed")), round_=0)


def q_detect_rules_conversations(spark, sf_dir):
    conv = spread(table(spark, sf_dir, "conversations")).select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"),
        F.col("text").alias("content"))
    return detect_rules(examinable(chunk_documents(conv, method="fixed")), round_=0)


def q_detect_dictionary(spark, sf_dir):
    return detect_dictionary(fixed_chunks(spark, sf_dir), terms_table(spark, DICTIONARY_TERMS), round_=0)


def q_prompt_column(spark, sf_dir):
    return fixed_chunks(spark, sf_dir).select("doc_id", "chunk_index", render_prompt(F.col("content")).alias("prompt"))


def _answer_variants(answers: DataFrame) -> DataFrame:
    """Well-formed and malformed detector answers per productive chunk (D5-D7 cases)."""
    p = F.col("payload")
    first = F.to_json(F.element_at(F.from_json(p, "array<struct<text:string,category:string,type:string,justification:string>>"), 1))
    variants = F.array(
        F.struct(F.lit("fenced").alias("variant"), fenced(p).alias("answer")),
        F.struct(F.lit("bare").alias("variant"), p.alias("answer")),
        F.struct(F.lit("empty").alias("variant"), fenced(F.lit("[]")).alias("answer")),
        F.struct(F.lit("object").alias("variant"), fenced(first).alias("answer")),
        F.struct(F.lit("truncated").alias("variant"), fenced(F.expr("substring(payload, 1, length(payload) - 2)")).alias("answer")),
        F.struct(F.lit("trailing").alias("variant"), fenced(F.concat(p, F.lit("x"))).alias("answer")),
        F.struct(F.lit("twice").alias("variant"), fenced(F.concat(p, p)).alias("answer")),
        F.struct(F.lit("listed").alias("variant"), fenced(F.concat(p, F.lit(", "), p)).alias("answer")),
        F.struct(F.lit("after").alias("variant"), fenced(F.concat(p, F.lit(" [1]"))).alias("answer")),
        F.struct(F.lit("closed").alias("variant"), fenced(F.concat(p, F.lit("] [1]"))).alias("answer")),
    )
    return answers.select("doc_id", "chunk_index", F.explode(variants).alias("v")).select(
        "doc_id", "chunk_index", "v.variant", "v.answer")


def q_payload_parse(spark, sf_dir):
    answers = _answer_variants(payloads(round0(spark, sf_dir)))
    modes = answers.select("doc_id", "chunk_index", "variant",
                           F.explode(F.array(
                               F.struct(F.lit("detect").alias("mode"), parse_items(strip_fence(F.col("answer"), True)).alias("items")),
                               F.struct(F.lit("combine").alias("mode"), parse_items(strip_fence(F.col("answer"), False)).alias("items")),
                           )).alias("m"))
    rows = modes.select("doc_id", "chunk_index", "variant", "m.mode", F.posexplode("m.items").alias("item_pos", "item"))
    return rows.select("doc_id", "chunk_index", "variant", "mode", F.col("item_pos").cast("long").alias("item_pos"),
                       *[F.col("item")[f].alias(f) for f in ITEM_FIELDS])


def q_group_items(spark, sf_dir):
    p = payloads(round0(spark, sf_dir))
    parsed = F.from_json(F.col("payload"), "array<struct<text:string,category:string>>")
    return p.select("doc_id", "round", "chunk_index", "n_items",
                    F.array_join(F.transform(parsed, lambda x: F.concat_ws("\t", x["text"], x["category"])), "\n")
                    .alias("items_text"))


def _two_rounds(spark, sf_dir):
    return scan_rounds(fixed_chunks(spark, sf_dir), rules_detector(), max_rounds=2).drop_chunks()


def q_combine_items(spark, sf_dir):
    dets = _two_rounds(spark, sf_dir).detections
    return combine_payloads(model_answers(dets).select("doc_id", "round", "chunk_index",
                                                       F.col("answer").alias("payload")), require_fence=False)


def q_fold_text(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    f = fold(F.col("text"))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), f.alias("folded"), casefold(f).alias("match_key"))


def q_chunks_with_items(spark, sf_dir):
    chunks, dets = mask_inputs(spark, sf_dir)
    return chunks_with_items(chunks, dets)


def q_match_ranges(spark, sf_dir):
    chunks, dets = mask_inputs(spark, sf_dir)
    r = ranges_per_chunk(chunks, doc_items(dets))
    return r.select("doc_id", "chunk_index", F.explode("ranges").alias("r")).select(
        "doc_id", "chunk_index", "r.s", "r.e").distinct()


def q_merged_ranges(spark, sf_dir):
    chunks, dets = mask_inputs(spark, sf_dir)
    r = ranges_per_chunk(chunks, doc_items(dets))
    return r.select("doc_id", "chunk_index", F.explode(merge_ranges_col("ranges")).alias("r")).select(
        "doc_id", "chunk_index", "r.s", "r.e")


def q_mask_documents(spark, sf_dir):
    chunks, dets = mask_inputs(spark, sf_dir)
    return mask_documents(chunks, doc_items(dets))


def q_two_rounds(spark, sf_dir):
    return _two_rounds(spark, sf_dir).detections


def q_two_rounds_first_match(spark, sf_dir):
    """Round 0 reports one item a chunk, so masking it lets round 1 find the next."""
    return scan_rounds(fixed_chunks(spark, sf_dir), first_match_detector(), max_rounds=2).drop_chunks().detections


def q_findings_first_match(spark, sf_dir):
    """P2, P3 over items of both rounds."""
    return findings(q_two_rounds_first_match(spark, sf_dir))


def q_findings(spark, sf_dir):
    return findings(_two_rounds(spark, sf_dir).detections)


def email_answers(texts: pd.Series) -> pd.Series:
    """Deterministic stand-in for a model client: fenced JSON of the email rule's matches."""
    import json
    import re as _re

    rule = DEFAULT_RULES[0]
    pat = _re.compile(rule.pattern)

    def answer(t: str) -> str:
        items = [{"text": m, "category": rule.category, "type": rule.type, "justification": rule.justification}
                 for m in pat.findall(t or "")]
        return FENCE_OPEN + json.dumps(items) + FENCE_CLOSE

    return texts.map(answer)


def q_model_detect(spark, sf_dir):
    return detect_with(fixed_chunks(spark, sf_dir), email_answers, round_=0)


def _corpus_paths(spark, sf_dir) -> DataFrame:
    """A path table derived from the documents: one file per document, kinds cycling by id."""
    # File-name endings used to exercise the extension and MIME rules.
    endings = [".txt", ".md", ".docx", ".pdf", ".rtf", ".odt", ".TXT", ".html", "", ".tar.gz", ".Md", ".json"]
    docs = table(spark, sf_dir, "documents")
    ending = F.element_at(F.lit(endings), (F.col("doc_id") % len(endings) + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc-"),
                    F.col("doc_id").cast("string"), ending)
    return docs.select(path.alias("path"), F.encode(F.col("text"), "UTF-8").alias("content"),
                       F.col("n_chars").alias("length"))


def q_file_mime(spark, sf_dir):
    p = _corpus_paths(spark, sf_dir)
    return p.select("path", extension(F.col("path")).alias("ext"), mime_type(F.col("path"), F.col("content")).alias("mime"))


def q_file_ids(spark, sf_dir):
    p = _corpus_paths(spark, sf_dir).select("path", "length")
    return consecutive_ids(p, [F.col("length"), F.col("path")]).withColumn("file_id", F.col("file_id").cast("string"))


def q_file_listing(spark, sf_dir):
    """S1-S13 on real files: Spark writes the documents as text files, then lists and loads them.

    How many files there are depends on the partitions; files, characters and lines per folder do not.
    """
    base = os.path.join(ensure_checkpoint_dir(spark), f"corpus-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    docs.select("lang", "source", "text").where("text is not null").write.partitionBy("lang", "source").text(base)
    ok, _ = extract_documents(list_files(spark, base, recursive=True, extensions=["txt"], id_mode="hash"))
    folder = ok.select(F.regexp_extract("path", "/lang=([^/]*)/source=([^/]*)/", 1).alias("lang"),
                       F.regexp_extract("path", "/lang=([^/]*)/source=([^/]*)/", 2).alias("source"),
                       F.length("text").alias("n"), F.regexp_count("text", F.lit("\n")).alias("lines"))
    sums = folder.groupBy("lang", "source").agg(F.sum("n").cast("long").alias("n_chars"), F.sum("lines").cast("long").alias("n_lines"))
    return result(sums, base)


def q_scan_documents(spark, sf_dir):
    """Flagship: documents -> clean -> recursive chunks -> rules, two rounds -> findings."""
    return find_items(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "load_documents": q_load_documents,
    "clean_pages": q_clean_pages,
    "chunk_fixed": q_chunk_fixed,
    "chunk_tidy": q_chunk_tidy,
    "chunk_short": q_chunk_short,
    "chunk_recursive": q_chunk_recursive,
    "detect_rules": q_detect_rules,
    "detect_rules_pages": q_detect_rules_pages,
    "detect_rules_conversations": q_detect_rules_conversations,
    "detect_dictionary": q_detect_dictionary,
    "prompt_column": q_prompt_column,
    "payload_parse": q_payload_parse,
    "group_items": q_group_items,
    "combine_items": q_combine_items,
    "fold_text": q_fold_text,
    "chunks_with_items": q_chunks_with_items,
    "match_ranges": q_match_ranges,
    "merged_ranges": q_merged_ranges,
    "mask_documents": q_mask_documents,
    "two_rounds": q_two_rounds,
    "two_rounds_first_match": q_two_rounds_first_match,
    "findings": q_findings,
    "findings_first_match": q_findings_first_match,
    "model_detect": q_model_detect,
    "file_mime": q_file_mime,
    "file_ids": q_file_ids,
    "file_listing": q_file_listing,
    "scan_documents": q_scan_documents,
}


def q_stage_counts(spark, sf_dir):
    """P5: rows per stage (documents, chunks, examined chunks, items, unique items) for round 0."""
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & (F.length("text") > 0))
    chunks = fixed_chunks(spark, sf_dir, tidy=False)
    examined = fixed_chunks(spark, sf_dir)
    dets = detect_rules(examined, round_=0)
    parts = [("documents", docs), ("chunks", chunks), ("examined", examined), ("items", dets),
             ("unique_items", findings(dets))]
    out = None
    for name, df in parts:
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def q_detect_rules_checked(spark, sf_dir):
    """D1 with the optional validations: Luhn checksum for cards, octets <= 255 for IPs."""
    return detect_rules(fixed_chunks(spark, sf_dir), with_checks(), round_=0)


def q_mask_documents_indexed(spark, sf_dir):
    """M5-M9 through the q-gram index join for every document (the path for documents with many items)."""
    chunks, dets = mask_inputs(spark, sf_dir)
    return mask_documents(chunks, doc_items(dets), max_inline_items=0)


def q_chunks_with_items_indexed(spark, sf_dir):
    """M2-M4 through the q-gram index join for every document."""
    chunks, dets = mask_inputs(spark, sf_dir)
    return chunks_with_items(chunks, dets, max_inline_items=0)


# Multi-word stand-ins (word sequences that occur in the synthetic prose).
PHRASE_TERMS = (
    ("Eriner thanea", "name", "direct", "Listed in the name dictionary."),
    ("Nicht aulich", "location data", "indirect", "Listed in the place dictionary."),
    ("Orre Orre", "name", "direct", "Listed in the name dictionary."),
    ("Orre", "name", "direct", "Listed in the name dictionary."),
)


def q_detect_dictionary_phrases(spark, sf_dir):
    """D2 with multi-word terms: whitespace-separated token sequences, overlapping matches included."""
    return detect_dictionary(fixed_chunks(spark, sf_dir), terms_table(spark, PHRASE_TERMS), round_=0)


def q_scan_documents_fixed(spark, sf_dir):
    """End to end (clean, chunk, two rounds, findings) with the fixed-window chunker."""
    return find_items(table(spark, sf_dir, "documents"), chunker="fixed")


def q_scan_pages(spark, sf_dir):
    """End to end over raw web pages: markup cleaning, fixed chunks, two rounds, findings."""
    pages = spread(table(spark, sf_dir, "pages"))
    return find_items(pages, id_col="page_id", text_col="html", chunker="fixed")


def q_detect_rules_more(spark, sf_dir):
    """D1 with looser forms: national phones, IPv6, grouped cards, equipment numbers, grouped account numbers."""
    return detect_rules(fixed_chunks(spark, sf_dir), MORE_RULES, round_=0)


def q_answer_rejects(spark, sf_dir):
    """Why malformed answers give no items, as the detection and as the combining step read them."""
    answers = _answer_variants(payloads(round0(spark, sf_dir)))
    both = answers.select("doc_id", "chunk_index", "variant", F.explode(F.array(
        F.struct(F.lit("detect").alias("mode"), reject_reason(F.col("answer"), True).alias("reason")),
        F.struct(F.lit("combine").alias("mode"), reject_reason(F.col("answer"), False).alias("reason")))).alias("m"))
    return both.select("doc_id", "chunk_index", "variant", "m.mode", "m.reason").where("reason is not null")


QUERIES.update({
    "detect_rules_more": q_detect_rules_more,
    "answer_rejects": q_answer_rejects,
    "stage_counts": q_stage_counts,
    "detect_rules_checked": q_detect_rules_checked,
    "mask_documents_indexed": q_mask_documents_indexed,
    "chunks_with_items_indexed": q_chunks_with_items_indexed,
    "detect_dictionary_phrases": q_detect_dictionary_phrases,
    "scan_documents_fixed": q_scan_documents_fixed,
    "scan_pages": q_scan_pages,
})


def merge_lines(prompt: str) -> str:
    """Deterministic stand-in for a model client: all objects of the lists' lines as one fenced array."""
    import json

    items = [x for line in prompt.split("\n") if line.startswith("- ") for x in json.loads(line[2:])]
    return FENCE_OPEN + json.dumps(items) + FENCE_CLOSE


def q_combine_with_function(spark, sf_dir):
    """A caller's function merges each document's payloads of both rounds, in order."""
    answers = model_answers(_two_rounds(spark, sf_dir).detections)
    return combine_with(answers.select("doc_id", "round", "chunk_index", F.col("answer").alias("payload")), merge_lines)[0]


def q_findings_nested(spark, sf_dir):
    """The nested sink, read back. A fifth of the documents have masked items alone, so they keep an
    empty list, and every third document one masked item more."""
    dets = round0(spark, sf_dir)
    masked = F.when(F.col("doc_id").cast("long") % 5 == 0, F.concat(F.lit("****"), F.col("text"))).otherwise(F.col("text"))
    more = dets.where(F.col("doc_id").cast("long") % 3 == 0).withColumn("text", F.concat(F.lit("x****"), F.col("text")))
    dets = dets.withColumn("text", masked).unionByName(more.withColumn("round", F.lit(1)))
    base = os.path.join(ensure_checkpoint_dir(spark), f"nested-{uuid.uuid4().hex}")
    write_nested(save_table(dets, prefix="detections"), base)
    back = spark.read.schema(f"id string, pii {ITEMS.simpleString()}").json(base)
    return result(back.select("id", F.size("pii").cast("long").alias("n_items"), F.array_join(F.transform(
        "pii", lambda x: F.concat_ws("|", *[x[f] for f in ITEM_FIELDS])), ";").alias("items")), base)


QUERIES.update({**FILE_QUERIES, "combine_with_function": q_combine_with_function, "findings_nested": q_findings_nested})
