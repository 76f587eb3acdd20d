"""Merging by a caller's function (G1-G3, G5) and the nested sink."""

import json

from pyspark.sql import functions as F

from shroud.operators.findings import combine_with, findings_nested, write_nested
from shroud.plans.queries import merge_lines

PAYLOADS = "doc_id string, round int, chunk_index int, payload string"
DETECTIONS = "doc_id string, chunk_index int, round int, item_pos long, text string, category string, type string, justification string"


def array(*texts):
    return json.dumps([{"text": t, "category": "name"} for t in texts])


def rows(df):
    return sorted((r.doc_id, r.item_pos, r.text) for r in df.collect())


def test_merge_in_order_and_in_parts(spark):
    data = [("a", 1, 0, array("a3")), ("a", 0, 7, array("a1", "a2")), ("a", 0, 9, "no json"), ("b", 0, 0, "```json\n" + array("b1") + "\n```"),
            ("", 0, 0, array("none")), (None, 0, 0, array("none")), ("c", 0, 0, "[]")]
    df = spark.createDataFrame(data, PAYLOADS).repartition(5)
    for size in (1, 60, 100_000):
        merged, rejects = combine_with(df, merge_lines, max_chars=size)
        assert rows(merged) == [("a", 0, "a1"), ("a", 1, "a2"), ("a", 2, "a3"), ("b", 0, "b1")]
        assert rejects.collect() == []


def test_function_sees_the_list(spark):
    df = spark.createDataFrame([("a", 0, 1, array("y")), ("a", 0, 0, array("x"))], PAYLOADS)
    echo = lambda prompt: json.dumps([{"text": prompt}])
    (r,) = combine_with(df, echo, template="<{text}>")[0].collect()
    assert r.text == '<- [{"text":"x","category":"name"}]\n- [{"text":"y","category":"name"}]>'


def test_a_failing_merge_loses_only_its_document(spark):
    def merge(prompt):
        if "boom" in prompt:
            raise RuntimeError("no answer")
        return "sorry" if "odd" in prompt else merge_lines(prompt)

    df = spark.createDataFrame([(d, 0, i, array(t)) for d, ts in (("a", ["ok", "fine"]), ("b", ["x", "boom"]), ("c", ["odd"]), ("d", ["ok"])) for i, t in enumerate(ts)], PAYLOADS)
    merged, rejects = combine_with(df, merge, max_chars=10)
    assert rows(merged) == [("a", 0, "ok"), ("a", 1, "fine"), ("d", 0, "ok")]
    assert {r.doc_id: r.reason for r in rejects.collect()} == {"b": "RuntimeError: no answer", "c": "no array of items"}


def read(path):
    return {d["id"]: d["pii"] for p in sorted(path.glob("part-*.json")) for d in map(json.loads, p.read_text().splitlines())}


def test_nested_sink(spark, tmp_path):
    data = [("1", 0, 0, 0, "b", "name", "direct", None), ("1", 0, 0, 1, 'quo"te\n', "name", "direct", "j"), ("1", 3, 1, 0, "b", "name", "late", "j"),
            ("2", 0, 0, 0, "****", "name", "direct", "j"), ("3", 0, 0, 0, "x****y", "name", "direct", "j"), ("3", 0, 0, 1, "ü", "name", "direct", "j")]
    df = spark.createDataFrame(data, DETECTIONS).repartition(4)
    assert write_nested(df, str(tmp_path / "out")) == 3
    assert read(tmp_path / "out") == {"1": [{"text": "b", "category": "name", "type": "direct"}, {"text": 'quo"te\n', "category": "name", "type": "direct", "justification": "j"}],
                                      "2": [], "3": [{"text": "ü", "category": "name", "type": "direct", "justification": "j"}]}
    nested = {r.id: [{k: v for k, v in x.asDict().items() if v is not None} for x in r.pii] for r in findings_nested(df).collect()}
    assert nested == read(tmp_path / "out")
    assert not list((tmp_path / "out").glob("*.tmp"))
    assert write_nested(df.limit(0), str(tmp_path / "none")) == 0


def test_a_document_of_a_million_items(spark, tmp_path):
    n = 1_000_000
    df = spark.range(0, n, 1, 8).select(F.lit("big").alias("doc_id"), (F.col("id") / 100).cast("int").alias("chunk_index"), F.lit(0).alias("round"),
                                        (F.col("id") % 100).alias("item_pos"), F.concat(F.lit("t"), F.col("id")).alias("text"),
                                        F.lit("name").alias("category"), F.lit("direct").alias("type"), F.lit("j").alias("justification"))
    assert write_nested(df, str(tmp_path / "out")) == 1
    pii = read(tmp_path / "out")["big"]
    assert len(pii) == n and [x["text"] for x in pii[:3]] == ["t0", "t1", "t2"] and pii[-1]["text"] == f"t{n - 1}"
