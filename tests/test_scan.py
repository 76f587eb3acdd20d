"""End-to-end detection: rounds, stage counts (P5) and the sink."""

import json
import os
import tempfile

from conftest import SF_SMALL
from shroud.operators.findings import write_findings
from shroud.plans.scan import combined_detector, detect_documents, dictionary_detector, rules_detector
from shroud.operators.detect import terms_table


def test_rounds_counts_and_sink(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    res = detect_documents(docs, chunker="fixed")
    counts = res.stage_counts()
    assert counts["documents"] == docs.count()
    assert counts["chunks"] >= counts["documents"]
    assert counts["items_round_0"] > 0 and res.rounds_run == 2
    out = os.path.join(tempfile.mkdtemp(prefix="shroud-sink-"), "findings")
    write_findings(res.detections, out, nested=True)
    lines = [json.loads(x) for x in spark.read.text(out).toPandas()["value"]]
    assert lines and all(set(x) == {"id", "pii"} for x in lines)
    assert all(set(p) == {"text", "category", "type", "justification"} for x in lines for p in x["pii"])


def test_combined_detectors_keep_order_keys_apart(spark):
    docs = spark.createDataFrame([(1, "Mail ann@x.org to Orre today.")], "doc_id long, text string")
    det = combined_detector(rules_detector(), dictionary_detector(terms_table(spark, [("Orre", "name", "direct", "listed")])))
    rows = detect_documents(docs, detector=det, chunker="fixed").detections.orderBy("item_pos").collect()
    assert [(r.text, r.category) for r in rows] == [("ann@x.org", "email"), ("Orre", "name")]
    assert rows[1].item_pos >= 1_000_000_000


def test_no_items_gives_empty_result_with_schema(spark):
    docs = spark.createDataFrame([(1, "nothing personal here")], "doc_id long, text string")
    res = detect_documents(docs)
    assert res.detections.count() == 0 and res.rounds_run == 1
    assert "text" in res.detections.columns


def test_chunk_groups_give_same_results(spark):
    """Long documents split into chunk groups (forced with a tiny group size) change nothing in the results."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cols = ["doc_id", "chunk_index", "round", "item_pos", "text", "category", "type", "justification"]
    a = detect_documents(docs, chunker="fixed", group_chunks=None)
    b = detect_documents(docs, chunker="fixed", group_chunks=2)
    assert "grp" in b.chunks.columns and b.chunks.where("grp > 0").count() > 0
    assert sorted(map(tuple, a.detections.select(*cols).collect())) == sorted(map(tuple, b.detections.select(*cols).collect()))
    ca = {(r.doc_id, r.chunk_index): (r.content, r.changed) for r in a.chunks.collect()}
    cb = {(r.doc_id, r.chunk_index): (r.content, r.changed) for r in b.chunks.collect()}
    assert ca == cb


def test_later_rounds_see_what_masking_uncovers(spark):
    """One item a chunk and round: with enough rounds every item is found, each masked before the next."""
    from shroud.plans.scan import first_match_detector

    text = "a@b.org then c@d.org then e@f.org"
    docs = spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    res = detect_documents(docs, detector=first_match_detector(), chunker="fixed", max_rounds=5)
    assert [(r.round, r.text) for r in res.detections.orderBy("round").collect()] == [(0, "a@b.org"), (1, "c@d.org"), (2, "e@f.org")]
    assert {r.doc_id: (r.content, r.changed) for r in res.chunks.collect()} == {
        "1": ("******* then ******* then *******", True), "2": ("nothing here", False)}


def test_failed_answers_get_a_second_chance(spark):
    """Documents without items are examined again for a detector that may answer differently."""
    from shroud.operators.detect import detect_rules
    from shroud.plans.scan import deterministic

    docs = spark.createDataFrame([(1, "a@b.org"), (2, "c@d.org")], "doc_id long, text string")

    def moody(chunks, r):
        return detect_rules(chunks if r else chunks.where("doc_id = '1'"), round_=r)

    found = lambda d: sorted((r.round, r.text) for r in detect_documents(docs, detector=d, chunker="fixed").detections.collect())
    assert found(moody) == [(0, "a@b.org"), (1, "c@d.org")]
    assert found(deterministic(lambda c, r: moody(c, r))) == [(0, "a@b.org")]


def test_repeated_ids_keep_their_texts(spark):
    from shroud.operators.mask import mask_documents, masked_changes

    rows = [("1", 0, "aaa bob zzz"), ("1", 0, "xx yyyyy bob"), ("1", 0, "xx yyyyy bob"), ("2", 0, "bob")]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, content string")
    items = spark.createDataFrame([("1", "bob")], "doc_id string, text string")
    for inline in (512, 0):
        got = sorted((r.doc_id, r.content) for r in mask_documents(chunks, items, inline).collect())
        assert got == [("1", "aaa *** zzz"), ("1", "xx yyyyy ***"), ("1", "xx yyyyy ***"), ("2", "bob")]
        assert masked_changes(chunks, items, inline).count() == 3


def test_items_that_begin_alike_meet_few_positions(spark):
    from shroud.operators.mask import qgram_candidates

    phones = [f"+1 (202) 555-{i:04d}" for i in range(800)]
    chunks = spark.createDataFrame([("1", 0, " ".join(phones), 7)], "doc_id string, chunk_index int, content string, _row long")
    items = spark.createDataFrame([("1", p) for p in phones], "doc_id string, fi string")
    hits = qgram_candidates(chunks.withColumn("_ft", chunks.content), "_ft", items, "fi")
    assert hits.count() == 800
    pairs = hits._jdf.queryExecution().toString()
    assert "Generate" in pairs


def test_round_tables_are_removed(spark):
    import glob

    from shroud.plans.scan import find_items
    from shroud.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/tables/*"))
    rows = find_items(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), chunker="fixed")
    left = {p.rpartition("/")[2].partition("_")[0] for p in set(glob.glob(f"{folder}/tables/*")) - before}
    assert left == {"detections"} and rows.count() > 0
    assert spark.catalog.listTables() == [] or all("chunks" not in t.name for t in spark.catalog.listTables())


def test_scan_documents_equals_brute_force(spark):
    """Rows-only flagship query against a plain-Python rendering of the whole flow on sf0.001."""
    import re

    import __spark_entry__ as E
    from shroud.operators.chunk import recursive_split
    from shroud.operators.detect import DEFAULT_RULES
    from test_clean import walked
    from test_detect import py_rule_matches
    from test_mask import _starred

    def detect(chunks, rnd):
        out = []
        for (d, i), c in chunks.items():
            if not c.strip():
                continue
            pos = 0
            for rule in DEFAULT_RULES:
                for m in py_rule_matches(rule, c):
                    out.append((d, rnd, i, pos, m, rule.category, rule.type, rule.justification))
                    pos += 1
        return out

    chunks = {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        t = walked(r.text)
        if not t:
            continue
        pieces = [t] if len(t) < 1024 else [re.sub(r"\n+", " ", c.strip()) for c in recursive_split(t, 1024, 128) if c.strip()]
        for i, p in enumerate(pieces):
            chunks[(str(r.doc_id), i)] = p
    dets = detect(chunks, 0)
    items = {}
    for d, *_rest in dets:
        items.setdefault(d, set()).add(_rest[3])
    masked = {k: _starred(c, sorted(items.get(k[0], ()))) for k, c in chunks.items()}
    dets += detect({k: c for k, c in masked.items() if c != chunks[k]}, 1)
    best = {}
    for d, rnd, i, pos, text, cat, typ, just in sorted(dets, key=lambda x: (x[0], x[1], x[2], x[3])):
        if "****" in text:
            continue
        best.setdefault((d, f"{text}_{cat}"), (d, rnd, i, pos, text, cat, typ, just))
    want = sorted(best.values())
    got = sorted(tuple(r) for r in E.queries()["scan_documents"](spark, SF_SMALL).collect())
    assert got == want and want
