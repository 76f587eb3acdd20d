"""Chunking (K1-K7)."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from shroud.operators.chunk import (chunk_documents, examinable, fixed_windows, recursive_split,
                                    validate_chunk_params)


def test_fixed_window_lengths(spark):
    df = spark.createDataFrame([(n,) for n in (1024, 1025, 1921)], "n int").select(
        "n", F.expr("repeat('x', n)").alias("t"))
    got = {r.n: [len(x) for x in r.w] for r in df.select("n", fixed_windows(F.col("t")).alias("w")).collect()}
    assert got == {1024: [1024], 1025: [1024, 129], 1921: [1024, 1024, 129]}


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, -1), (10, 10), (10, 11)])
def test_bad_params(size, overlap):
    with pytest.raises(ValueError):
        validate_chunk_params(size, overlap)


def test_short_document_is_one_chunk(spark):
    docs = spark.createDataFrame([("a", "short text\n\nwith lines"), ("b", ""), ("c", None)], "doc_id string, content string")
    rows = chunk_documents(docs, method="recursive").collect()
    assert [(r.doc_id, r.chunk_index, r.content) for r in rows] == [("a", 0, "short text\n\nwith lines")]


def test_recursive_split_properties():
    text = ("Paragraph one. " * 60 + "\n\n" + "Line two, with words; more words: end.\n" * 40 + "x" * 3000)
    chunks = recursive_split(text, 1024, 128)
    assert all(len(c) <= 1024 for c in chunks)
    # every non-space character of the text is covered (order kept, overlap allowed)
    joined = "".join(chunks)
    for token in set(text.split()):
        assert token in joined or token[:1024] in joined
    # separators stay with the piece that follows them
    assert not any(c.startswith(" ") for c in chunks)


def test_recursive_chunks_properties(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("content"))
    chunks = chunk_documents(docs, method="recursive")
    rows = chunks.collect()
    texts = {r.doc_id: r.content for r in docs.collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
    assert set(by_doc) == {k for k, v in texts.items() if v}
    for doc, parts in by_doc.items():
        parts.sort()
        assert [i for i, _ in parts] == list(range(len(parts)))
        if len(texts[doc]) >= 1024:
            assert all(len(c) <= 1024 for _, c in parts)
            assert all("\n" not in c and c == c.strip() for _, c in parts)
        # every word of the text appears in some chunk (separators move to the next piece)
        words = set(re.findall(r"\w+", texts[doc]))
        covered = " ".join(c for _, c in parts)
        assert all(w in covered for w in words)


def test_blank_chunks_skipped(spark):
    df = spark.createDataFrame([("a", 0, " \n\t\x1c"), ("a", 1, "x")], "doc_id string, chunk_index int, content string")
    assert [r.chunk_index for r in examinable(df).collect()] == [1]


def test_recursive_chunks_equal_plain_python(spark):
    """Rows-only query chunk_recursive against a brute-force rendering on every sf0.001 document."""
    import __spark_entry__ as E

    got = {}
    for r in E.queries()["chunk_recursive"](spark, SF_SMALL).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = r.content
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    want = {}
    for d, t in texts.items():
        if not t:
            continue
        pieces = [t] if len(t) < 1024 else [re.sub(r"\n+", " ", c.strip()) for c in recursive_split(t, 1024, 128) if c.strip()]
        want[d] = dict(enumerate(pieces))
    assert got == want


def test_fixed_windows_count_code_points(spark):
    import random

    from shroud.operators.chunk import fixed_windows

    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n\r é\U0001f600 ") for _ in range(n)) for n in [*range(30), 100, 333]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for size, overlap in ((10, 3), (10, 5), (7, 0), (10, 9), (1, 0)):
        for r in df.select("t", fixed_windows(F.col("t"), size, overlap).alias("w")).collect():
            assert r.w == [r.t[p : p + size] for p in range(0, max(len(r.t) - overlap, 1), size - overlap)]


def windows_by_definition(text, size, overlap, separators):
    """The splitter from its rules alone, on positions: spans cut level by level, runs of short pieces merged by
    trying every start and end (no code of the library)."""
    if not separators[0] or separators[0] in text:
        sep = separators[0]
        if sep:
            cuts = [0, *[m.start() for m in re.finditer(re.escape(sep), text)], len(text)]
        else:
            cuts = list(range(len(text) + 1))
        cuts = sorted(set(cuts))
        spans = list(zip(cuts[:-1], cuts[1:]))
        out, run = [], []
        for a, b in [*spans, (None, None)]:
            if a is not None and b - a < size:
                run.append((a, b))
                continue
            i = 0
            while i < len(run):
                fits = [j for j in range(i, len(run)) if run[j][1] - run[i][0] <= size]
                j = max(fits) + 1
                out.append(text[run[i][0] : run[j - 1][1]])
                if j == len(run):
                    break
                i = next(k for k in range(i, j + 1) if run[j][0] - run[k][0] <= overlap and run[j][1] - run[k][0] <= size)
            run = []
            if a is not None:
                out += windows_by_definition(text[a:b], size, overlap, separators[1:]) if len(separators) > 1 else [text[a:b]]
        return out
    return windows_by_definition(text, size, overlap, separators[1:])


def test_recursive_split_equals_its_definition(spark):
    import random

    from shroud.operators.chunk import DEFAULT_SEPARATORS

    rng = random.Random(8)
    marks = ["\n\n", "\n", "\n\n\n", ". ", "! ", "; ", ", ", "... ", " ", "  ", "é", "\U0001f600", "a", "bcd", "x" * 30]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, content string")
    for size, overlap in ((20, 5), (25, 0), (12, 11), (60, 20)):
        got = {}
        for r in chunk_documents(df, size, overlap, tidy=False).collect():
            got.setdefault(r.doc_id, []).append((r.chunk_index, r.content))
        for i, t in enumerate(texts):
            if len(t) >= size:
                want = [x for c in windows_by_definition(t, size, overlap, DEFAULT_SEPARATORS) if (x := c.strip())]
                assert [c for _, c in sorted(got.get(i, []))] == want, (t, size, overlap)


def test_recursive_split_equals_sql(spark, tmp_path):
    """The relations of plans.sqlsplit on texts that the given tables do not have."""
    import random

    import duckdb

    from shroud.plans.sqlsplit import recursive_rows

    rng = random.Random(9)
    marks = ["\n\n", "\n", ". ", "? ", ": ", ", ", " ", "a", "bcd", "é", "x" * 25, "\t"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randrange(0, 120)))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id int, content string")
    df.write.parquet(str(tmp_path / "t"))
    sql = recursive_rows(f"read_parquet('{tmp_path}/t/*.parquet')", "doc_id", "content", 30, 8)
    want = sorted(duckdb.sql(sql).fetchall())
    got = chunk_documents(df, 30, 8).select(F.col("doc_id").cast("string"), "chunk_index", "content").collect()
    assert sorted(map(tuple, got)) == want
