"""Grouping, combining and post-processing."""

from pyspark.sql import functions as F

from shroud.operators.findings import combine_payloads, dedupe_items, findings_nested, model_answers, payloads

ITEMS = [
    ("John Doe", "name", True),
    ("John Doe", "name", False),
    ("John Doe", "signature", True),
    ("**** Doe", "name", False),
    ("*** x", "name", True),
    ("", "name", True),
    ("a_b", "c", True),
    ("a", "b_c", False),
]


def _dets(spark):
    rows = [("d", 0, i // 3, i % 3, t, c, "direct", f"j{i}") for i, (t, c, _) in enumerate(ITEMS)]
    return spark.createDataFrame(rows, "doc_id string, round int, chunk_index int, item_pos long, text string, "
                                       "category string, type string, justification string")


def test_dedupe_golden(spark):
    got = dedupe_items(_dets(spark)).orderBy("round", "chunk_index", "item_pos").collect()
    want = [(t, c) for t, c, keep in ITEMS if keep]
    assert [(r.text, r.category) for r in got] == want
    assert got[0].justification == "j0"  # first occurrence keeps its fields


def test_nested_shape_and_empty_list(spark):
    dets = _dets(spark).unionByName(
        _dets(spark).limit(1).select("round", "chunk_index", "item_pos", "type", "justification", "category",
                                     F.lit("e").alias("doc_id"), F.lit("**** masked").alias("text")))
    nested = {r.id: r.pii for r in findings_nested(dets).collect()}
    assert [p.text for p in nested["d"]] == [t for t, _, keep in ITEMS if keep]
    assert nested["e"] == []


def test_payload_roundtrip(spark):
    dets = _dets(spark)
    p = payloads(dets)
    assert sorted(r.n_items for r in p.collect()) == [2, 3, 3]
    back = combine_payloads(model_answers(dets).select("doc_id", "round", "chunk_index", F.col("answer").alias("payload")))
    cols = ["doc_id", "round", "chunk_index", "item_pos", "text", "category", "type", "justification"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, dets.select(*cols).collect()))
