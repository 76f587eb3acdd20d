"""Fill-in-the-middle against slices of the plain text, exact restoring, edges."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm.fill_in_middle import BlockTree, arrange, check_sentinels, fill_in_middle, restore


def plain_form(doc_id, text, pieces=list):
    """(output, form, n, prefix, middle) by slicing the list of units."""
    text = text or ""
    units = pieces(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", "spm", n, len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", "psm", n, len(p), len(m)


def rows_of(df):
    return [(r.doc_id, r.text, r.fim_form, r.fim_units, r.fim_prefix_chars, r.fim_middle_chars) for r in df.collect()]


def expected(rows, pieces=list):
    return [(i, *plain_form(i, t, pieces)) for i, t in rows]


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_tree_finds_every_cut(block):
    rng = random.Random(block)
    text = "".join(rng.choice("aé€🙂\n") for _ in range(200)).encode()
    raw = np.frombuffer(text, np.uint8)
    points = (raw & 0xC0) != 0x80
    units = points & (np.random.default_rng(1).random(len(raw)) < 0.3)
    units[0] = True
    tree = BlockTree(raw, units, points, block)
    starts = [*np.flatnonzero(units), len(raw)]
    assert tree.n_units == len(starts) - 1
    for k, at in enumerate(starts):
        assert tree.cut(k) == (at, points[:at].sum())
    assert tree.cut(len(starts) + 5) == (len(raw), points.sum())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = fill_in_middle(docs)
    assert out.columns[: len(docs.columns) - 1] == [c for c in docs.columns if c != "text"]
    assert order(rows_of(out)) == order(expected(rows))
    assert {r.fim_form for r in out.select("fim_form").collect()} == {"plain", "psm", "spm"}
    back = out.select("doc_id", restore(F.col("text"), F.col("fim_form")).alias("text"))
    assert order(map(tuple, back.collect())) == order((i, t or "") for i, t in rows)


def words(text):
    return re.findall(r"[^\W\d_]+[ ]?|(?s:.)", text)


def test_units_by_pattern(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(["ab ", "é", "€ ", "-", "\n", "long" * 30]) for _ in range(rng.randrange(80)))) for i in range(120)]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), unit=r"[^\W\d_]+[ ]?")
    assert order(rows_of(out)) == order(expected(rows, words))
    back = out.select("doc_id", restore(F.col("text"), F.col("fim_form")))
    assert order(map(tuple, back.collect())) == order(rows)


def test_edges(spark):
    long = "0123456789é🙂" * 40_000
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "null id"), (4, "has <S> inside"), (5, "<" * 40), (6, "ends with <S"), (7, "<P" * 9),
            (8, long), (9, "\0 \0"), (-12, "negative id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fim_form string, `a.b` int")
    out = fill_in_middle(df)
    assert out.columns == ["doc_id", "a.b", "text", "fim_form", "fim_units", "fim_prefix_chars", "fim_middle_chars"]
    assert order(rows_of(out)) == order(expected(rows))
    back = out.select("doc_id", restore(F.col("text"), F.col("fim_form")))
    assert order(map(tuple, back.collect())) == order((i, t or "") for i, t in rows)
    assert fill_in_middle(df.limit(0)).collect() == []


def test_restoring_where_pieces_end_like_sentinels():
    for text in ("<S<S<", "<P<M<S", "<<<", "<M<P"):
        for a in range(0, 7):
            for b in range(0, 7):
                for spm in (0, 99):
                    out, form, n, p, m = arrange(np.frombuffer(text.encode(), np.uint8), (a, b, 0, spm))
                    x, y = sorted((a % (len(text) + 1), b % (len(text) + 1)))
                    parts = (text[:x], text[y:], text[x:y])
                    want = "<P>{}<S>{}<M>{}".format(*parts) if form == "psm" else "<S>{1}<P>{0}<M>{2}".format(*parts)
                    assert (out.decode(), n, p, m) == (want, len(text), x, y - x)


def test_sentinels_are_checked():
    check_sentinels(("<P>", "<S>", "<M>"))
    for bad in (("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("<a", "a>", "<M>"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            check_sentinels(bad)


def test_sentinels_of_ones_own(spark):
    marks = ("[[pre]]", "[[suf}", "[[mid}")
    rows = [(i, "text [[ number } " * (i % 5)) for i in range(60)]
    out = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=marks, fim_percent=100, spm_percent=50)
    back = out.select("doc_id", restore(F.col("text"), F.col("fim_form"), marks))
    assert order(map(tuple, back.collect())) == order(rows)
