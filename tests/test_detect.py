"""Detection (D1-D8) and the payload gate."""

import json
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shroud.functions.payload import parse_items, strip_fence
from shroud.operators.detect import DEFAULT_RULES, detect_dictionary, detect_rules, detect_with, render_prompt, terms_table


def py_rule_matches(rule, text):
    # Python's \b is Unicode-aware; the rule means the ASCII boundary, so spell it out.
    pat = rule.pattern.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")
    return re.findall(pat, text, flags=re.ASCII)


def test_java_patterns_equal_rule_semantics(spark):
    rnd = random.Random(3)
    pieces = ["1", "12", "123", "255", ".", ":", "-", " ", "é", "a", "F", "ab", "@", "x.y", "+1 ", "(555) ",
              "555-1234", "4111111111111111", "DE89370400440532013000", "00:1A:2b:3C:4d:5E", "123-45-6789",
              "_", "0f" * 20, "mail@host.example.org"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(str(i), 0, t) for i, t in enumerate(texts)], "doc_id string, chunk_index int, content string")
    got = {}
    for r in detect_rules(df, round_=0).collect():
        got.setdefault((r.doc_id, r.category), []).append((r.item_pos, r.text))
    for i, t in enumerate(texts):
        for rule in DEFAULT_RULES:
            want = py_rule_matches(rule, t)
            have = [x for _, x in sorted(got.get((str(i), rule.category), []))]
            assert have == want, (t, rule.category)


def test_rules_find_fixture_items(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    found = detect_rules(docs, round_=0).select("doc_id", "text", "category").distinct()
    counts = {r.category: r["count"] for r in found.groupBy("category").count().collect()}
    # distinct (document, text) hits at sf0.001 listed in FIXTURES.md
    assert counts.get("email") == 5 and counts.get("ip address") == 4
    assert counts.get("phone number") == 5 and counts.get("payment card") == 5


def test_dictionary_accent_and_case_insensitive(spark):
    chunks = spark.createDataFrame([("d", 0, "Met JOSÉ and jose, not Joseph.")], "doc_id string, chunk_index int, content string")
    terms = terms_table(spark, [("José", "name", "direct", "listed")])
    rows = detect_dictionary(chunks, terms, round_=0).orderBy("item_pos").collect()
    assert [(r.text, r.item_pos) for r in rows] == [("JOSÉ", 1), ("jose", 3)]


FENCED = "```json\n{}\n```"
ONE = '[{"text":"J","category":"name","type":"direct","justification":"x"}]'
GATE = [
    (FENCED.format(ONE), 1, 1),
    (ONE, 0, 1),
    (FENCED.format("[]"), 0, 0),
    (FENCED.format('{"text":"J"}'), 0, 0),
    (FENCED.format('[{"text":"J"'), 0, 0),
    (FENCED.format('[{"text":"J"}]x'), 0, 0),
]


def test_payload_gate(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _, _) in enumerate(GATE)], "i int, a string")
    rows = df.select("i", F.size(parse_items(strip_fence(F.col("a"), True))).alias("d"),
                     F.size(parse_items(strip_fence(F.col("a"), False))).alias("c")).collect()
    for r in rows:
        _, want_d, want_c = GATE[r.i]
        assert (max(r.d or 0, 0), max(r.c or 0, 0)) == (want_d, want_c), GATE[r.i][0]


def test_detect_with_user_function(spark):
    def answer(texts: pd.Series) -> pd.Series:
        def one(t):
            if "bad" in t:
                return "not json"
            items = [{"text": w, "category": "name", "type": "direct", "justification": "capitalised"}
                     for w in re.findall(r"\b[A-Z][a-z]+\b", t)]
            return "```json\n" + json.dumps(items) + "\n```"
        return texts.map(one)

    chunks = spark.createDataFrame([("a", 0, "Ann met Bob"), ("a", 1, "bad Chunk"), ("b", 0, "none here")],
                                   "doc_id string, chunk_index int, content string")
    rows = detect_with(chunks, answer, round_=0).orderBy("doc_id", "chunk_index", "item_pos").collect()
    assert [(r.doc_id, r.chunk_index, r.item_pos, r.text) for r in rows] == [("a", 0, 0, "Ann"), ("a", 0, 1, "Bob")]


def test_prompt_holds_text(spark):
    df = spark.createDataFrame([("hello {text}",)], "c string")
    p = df.select(render_prompt(F.col("c")).alias("p")).first().p
    assert "hello {text}" in p and "json" in p


def test_optional_checks(spark):
    from shroud.operators.detect import with_checks

    def luhn(s):
        total = 0
        for i, ch in enumerate(reversed(s)):
            d = int(ch)
            if i % 2 == 1:
                d = d * 2 - 9 if d * 2 > 9 else d * 2
            total += d
        return total % 10 == 0

    rnd = random.Random(11)
    cards = ["".join(rnd.choice("0123456789") for _ in range(16)) for _ in range(300)] + ["4111111111111111"]
    ips = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "10.0.0.300", "999.9.9.9"]
    text = " ".join(cards + ips)
    df = spark.createDataFrame([("d", 0, text)], "doc_id string, chunk_index int, content string")
    got = {(r.category, r.text) for r in detect_rules(df, with_checks(), round_=0).collect()}
    want = {("payment card", c) for c in cards if luhn(c)} | {("ip address", i) for i in ips
                                                              if all(int(o) <= 255 for o in i.split("."))}
    assert got == want and ("payment card", "4111111111111111") in got


def test_dictionary_multi_word_terms(spark):
    chunks = spark.createDataFrame([("d", 0, "Met John  Doe and JOHN\tDÖE, not John, Doe nor John Doey.")],
                                   "doc_id string, chunk_index int, content string")
    terms = terms_table(spark, [("John Doe", "name", "direct", "listed"), ("nor", "word", "indirect", "listed")])
    rows = detect_dictionary(chunks, terms, round_=0).orderBy("item_pos").collect()
    assert [(r.text, r.item_pos) for r in rows] == [("John  Doe", 1), ("JOHN\tDÖE", 4), ("nor", 9)]


def test_dictionary_phrase_at_chunk_end(spark):
    chunks = spark.createDataFrame([("d", 0, "ends with John"), ("d", 1, "John")], "doc_id string, chunk_index int, content string")
    terms = terms_table(spark, [("John Doe", "name", "direct", "listed")])
    assert detect_dictionary(chunks, terms, round_=0).count() == 0


def test_detect_with_setup_once_per_task(spark):
    def setup():
        import os

        pid = os.getpid()
        return lambda texts: texts.map(lambda t: "```json\n" + json.dumps(
            [{"text": w, "category": "word", "type": "indirect", "justification": str(pid)} for w in t.split()[:1]]) + "\n```")

    chunks = spark.createDataFrame([("a", i, f"w{i} x") for i in range(20)], "doc_id string, chunk_index int, content string").coalesce(1)
    rows = detect_with(chunks, setup=setup, round_=0).collect()
    assert sorted(r.text for r in rows) == sorted(f"w{i}" for i in range(20))
    assert len({r.justification for r in rows}) == 1  # one handle for the task


def test_a_term_keeps_all_its_categories(spark):
    from shroud.operators.detect import detect_dictionary, terms_table

    chunks = spark.createDataFrame([("d", 0, "In Paris today")], "doc_id string, chunk_index int, content string")
    terms = terms_table(spark, [("Paris", "name", "direct", "n"), ("paris", "location data", "indirect", "l"), ("Paris", "name", "direct", "n")])
    assert sorted(r.category for r in detect_dictionary(chunks, terms).collect()) == ["location data", "name"]


def test_more_rules(spark):
    from shroud.operators.detect import MORE_RULES, detect_rules

    cases = [("(202) 555-0123", True), ("202.555.0123", True), ("+44 20 7946 0958", True), ("2001:db8:0:0:0:0:0:1", True),
             ("4539148803436467", True), ("4539148803436468", False), ("4539 1488 0343 6467", True), ("4539-1488-0343-6468", False),
             ("490154203237518", True), ("490154203237519", False), ("DE89 3704 0044 0532 0130 00", True), ("12.50.2024", False)]
    chunks = spark.createDataFrame([(str(i), 0, f"see {t} here") for i, (t, _) in enumerate(cases)],
                                   "doc_id string, chunk_index int, content string")
    rows = detect_rules(chunks, MORE_RULES).collect()
    assert {int(r.doc_id) for r in rows if r.text == cases[int(r.doc_id)][0]} == {i for i, c in enumerate(cases) if c[1]}
    assert {r.doc_id for r in rows} == {str(i) for i, c in enumerate(cases) if c[1]}


def test_rejects_keep_what_was_wrong(spark):
    from shroud.operators.detect import answers_with, split_rejects

    good = '```json\n[{"text":"J","category":"name"},{"category":"x"}]\n```'
    texts = {"a": good, "b": "no fence", "c": "```json\n[{\n```", "d": "```json\n[]\n```", "e": "```json\n[{]\n```"}
    chunks = spark.createDataFrame([(k, 0, v) for k, v in texts.items()], "doc_id string, chunk_index int, content string")
    rows, rejects = split_rejects(answers_with(chunks, lambda s: s, round_=0))
    assert [(r.doc_id, r.text) for r in rows.collect()] == [("a", "J")]
    assert sorted((r.doc_id, r.reason) for r in rejects.collect()) == [
        ("a", "item without text"), ("b", "no fence"), ("c", "not a JSON array"), ("e", "invalid JSON")]
