"""Token hashes: texts that a polynomial hash modulo a power of two takes for equal, through the operators."""

import numpy as np
import pyarrow as pa
import pytest

from shroud.llm import kneser_ney as kn
from shroud.llm import textscan as ts
from shroud.llm.jaccard_forest import drop_near_duplicates, jaccard_join
from shroud.llm.line_dedup import dedup_lines


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


ONE, OTHER = thue_morse(1_024, "ab"), thue_morse(1_024, "ba")


def hashes(words):
    buf, off = ts.text_buffers(pa.array([" ".join(words)]))
    s, e, _ = ts.tokens(buf, off)
    return ts.token_hashes(buf, s, e)


def test_regular_words_differ():
    words = [thue_morse(n, x) for n in (512, 1_024, 4_096, 65_536) for x in ("ab", "ba", "ac", "ca")]
    assert len(set(hashes(words).tolist())) == len(words)
    lines = np.array([hashes(["left"])[0], hashes(["right"])[0]])
    tm = np.array([bin(i).count("1") % 2 for i in range(2_048)])
    runs = np.concatenate([lines[tm], lines[1 - tm]])
    a, b = ts.span_hash(ts.prefix_hash(runs), np.array([0, 2_048]), np.array([2_048, 4_096]))
    assert a != b


def test_equal_bytes_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 4))) for _ in range(5_000)]
    h = hashes(words)
    by = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)


def test_stretches_compare_by_their_running_sums():
    raw = np.frombuffer(b"xxhello worldyyhello worldz", np.uint8).astype(np.uint64) + np.uint64(1)
    prefix = ts.prefix_hash(raw)

    def stretch(origin, lo, hi):
        o, a, b = (np.array([x]) for x in (origin, lo, hi))
        return ts.shifted_difference(int(ts.between(prefix, o, b, o)[0]), int(ts.between(prefix, o, a, o)[0]), lo - origin)

    assert stretch(0, 2, 13) == stretch(13, 15, 26) == stretch(2, 2, 13)
    assert stretch(0, 2, 13) != stretch(13, 15, 27)


def test_no_text_is_deleted_or_merged_for_another(spark):
    docs = spark.createDataFrame([(1, f"{ONE}\nfirst"), (2, f"{OTHER}\nsecond")], "doc_id long, text string")
    assert {r.doc_id: r.n_deleted for r in dedup_lines(docs).collect()} == {1: 0, 2: 0}
    docs = spark.createDataFrame([(1, ONE), (2, OTHER)], "doc_id long, text string")
    assert len({r.class_id for r in jaccard_join(docs).collect()}) == 2
    assert drop_near_duplicates(docs).count() == 2


def test_words_keep_their_own_ids():
    pytest.importorskip("public_tokenizers")
    from shroud.llm.registry import tokenizer_file
    from shroud.llm.tokenize import tokenizer

    tok = tokenizer(tokenizer_file())
    for text, ids in zip([ONE, OTHER], tok.encode([ONE, OTHER]), strict=True):
        assert ids.tolist() == tok.full.encode(text, add_special_tokens=False).ids


def test_words_are_counted_apart(spark):
    docs = spark.createDataFrame([(1, ONE)], "doc_id long, text string")
    model = kn.train(docs)
    other = spark.createDataFrame([(2, OTHER), (3, ONE)], "doc_id long, text string")
    from pyspark.sql import functions as F

    assert {r.doc_id: r.n_known for r in kn.score(other, model, F.lit(True)).collect()} == {2: 1, 3: 2}
