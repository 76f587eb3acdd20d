"""D2 as a trie in the tasks: equal to the join, rows near the hits, keys equal to the columns' keys."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from shroud.functions.fold import match_key, python_match_key
from shroud.operators import detect
from shroud.operators.detect import Trie, _token_regex, detect_dictionary, terms_table

SCHEMA = "doc_id string, chunk_index int, content string"


def test_python_keys_equal_column_keys(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LN"]
    rng = random.Random(1)
    words = chars + ["".join(rng.choice(chars[:900]) for _ in range(rng.randrange(1, 9))) for _ in range(5_000)]
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", match_key(F.col("w")).alias("k")).collect():
        assert python_match_key(r.w) == r.k, (r.w, hex(ord(r.w[0])))


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_join(spark, seed):
    rng = random.Random(seed)
    words = ["a", "A", "é", "É", "e", "Straße", "STRASSE", "b_c", "12", "ﬁn", "fin", "x"]
    gaps = [" ", "  ", "\n", "\t ", ", ", "-", "", "　", "\x1c"]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(0, 25))) for _ in range(200)]
    terms = [(rng.choice([" ", "-", "  "]).join(rng.choice(words) for _ in range(rng.randrange(1, 4))), rng.choice(["name", "place"]), "t", "j") for _ in range(12)]
    terms += [terms[0], ("", "name", "t", "j"), ("...", "name", "t", "j"), (None, "name", "t", "j")]
    chunks = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)] + [("null", 0, None)], SCHEMA)
    table = terms_table(spark, terms)
    key = lambda r: tuple(map(str, r))
    by_trie = sorted(detect_dictionary(chunks, table, round_=1, pos_offset=7).collect(), key=key)
    by_join = sorted(detect_dictionary(chunks, table, round_=1, pos_offset=7, trie=False).collect(), key=key)
    assert by_trie == by_join and by_trie


def test_only_matches_become_rows(spark):
    chunks = spark.createDataFrame([(str(i), 0, "no hit " * 200 + ("John Doe" if i % 10 == 0 else "")) for i in range(100)], SCHEMA)
    found = detect_dictionary(chunks, terms_table(spark, [("John Doe", "name", "direct", "l")]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan
    assert found.count() == 10


def test_larger_dictionaries_are_joined(spark, monkeypatch):
    chunks = spark.createDataFrame([("d", 0, "one two three")], SCHEMA)
    terms = terms_table(spark, [("one", "c", "t", "j"), ("three", "c", "t", "j")])
    for name, value in (("TRIE_TERMS", 1), ("TRIE_BYTES", 5)):
        with monkeypatch.context() as m:
            m.setattr(detect, name, value)
            found = detect_dictionary(chunks, terms)
            assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.text for r in found.collect()) == ["one", "three"]
    assert detect_dictionary(chunks, terms.limit(0)).count() == 0


def test_overlapping_terms():
    trie = Trie([("a b", "1", "t", "j"), ("b", "2", "t", "j"), ("a b c", "3", "t", "j"), ("a", "4", "t", "j"), ("A", "4", "t", "j")])
    found = [(i, text, item[0]) for i, text, item in trie.find("x A  b c, a b-c", _token_regex())]
    assert found == [(1, "A", "4"), (1, "A  b", "1"), (1, "A  b c", "3"), (2, "b", "2"), (4, "a", "4"), (4, "a b", "1"), (5, "b", "2")]
