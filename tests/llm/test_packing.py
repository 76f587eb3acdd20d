"""Packing: an exact round trip of every id, gapless sequences, no padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shroud.llm.packing import SumOfSquares, lay_out, pack_documents
from shroud.llm.registry import tokenizer_file
from shroud.llm.tokenize import WordTokenizer

TEXTS = ["", "a", "it's a dog's 'life' don''t", "ΣΑΣ ΟΔΟΣ straße İstanbul", "<|endoftext|> a<|startoftext|>", "x y 1234 !!??",
         "é é", "\x1c \x85 a\x0bb", "AÇÃO ñ ß ŋ ŉ ſ µ ª º ²½", "日本語 text", "tab\tnl\n\nz", "- ' \" `", " a­b", "\U0001f600 ok"]


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(tokenizer_file())


def ids_of(words, text):
    return words.full.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizer(words):
    assert [x.tolist() for x in words.encode(TEXTS * 2, max_chars=40)] == [ids_of(words, t) for t in TEXTS * 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F, exclude_categories=["Cs"]),
                                           st.sampled_from("ab 'S9!ſıİ")), max_size=30), max_size=6))
def test_ids_of_any_text(words, texts):
    assert [x.tolist() for x in words.encode(texts)] == [ids_of(words, t) for t in texts]


def test_placement_is_least_sum_of_squares():
    rng = np.random.default_rng(4)
    levels = SumOfSquares(32)
    for i in range(400):
        size = int(rng.integers(1, 32))
        n = levels.count.astype(int).tolist()

        def after(h, n=n, size=size):
            m = list(n)
            if h:
                m[h] -= 1
            if h + size < 32:
                m[h + size] += 1
            return sum(x * x for x in m[1:32])

        options = [0] + [h for h in range(1, 33 - size) if n[h]]
        full = levels.place(("d", i), size)
        now = levels.count.astype(int).tolist()
        assert sum(x * x for x in now[1:32]) == min(map(after, options))
        assert [len(x) for x in levels.open] == [int(x) for x in levels.count]
        assert full is None or full[-1] == ("d", i)


def test_last_sequences_are_powers_of_two():
    pieces = [("a", 0, np.arange(13), 13), ("b", 0, np.arange(6), 6)]
    sizes = [sum(len(p[2]) for p in s) for s in lay_out(iter(pieces), 8)]
    assert sizes == [8, 8, 2, 1]


def check(rows, docs, words, window):
    want = [(i, [*ids_of(words, t), 1]) for i, t in docs]
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert total == window or total & (total - 1) == 0
        assert {r.sequence_length for r in pieces} == {total}
    for doc in {i for i, _ in want}:
        copies = [ids for i, ids in want if i == doc]
        got = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[doc])
        if len(copies) == 1:
            (ids,) = copies
            assert [s for s, _, _ in got] == [sum(n for _, n, _ in got[:k]) for k in range(len(got))]
            assert sum(n for _, n, _ in got) == len(ids) == by_doc[doc][0].doc_tokens
            assert all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for s, n, c in got)
        else:
            assert sum(n for _, n, _ in got) == sum(map(len, copies))


def test_documents(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(pack_documents(docs, tokenizer_file()).collect(), [tuple(r) for r in docs.collect()], words, 2048)


def test_edges(spark, words):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, ""), (102, "w " * 30_000), (103, "b"), (103, "b"), (None, "c d")]
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, sequence_id int")
    check(pack_documents(df, tokenizer_file(), window=64).collect(), docs, words, 64)
    assert pack_documents(df.limit(0), tokenizer_file()).collect() == []
    with pytest.raises(ValueError):
        pack_documents(df, tokenizer_file(), window=100)
