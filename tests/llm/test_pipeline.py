"""The pipeline's stages, each against a brute-force version on its own input."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as cp
from shroud.llm.common import materialize, table
from shroud.llm.registry import tokenizer_file
from shroud.llm.tokenize import WordTokenizer

from .test_jaccard_forest import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, DIR, "documents")]
    for _, stage in cp.STAGES:
        docs.append(materialize(stage(spark, docs[-1], DIR), "pipeline-test"))
    return docs


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert all(d.columns == steps[0].columns for d in steps[:-1])


def test_quality_rejects_junk_and_keeps_clean(spark, steps):
    kept, labels = rows(steps[1]), table(spark, DIR, "labels").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i not in kept for i in bad) >= 0.9 * len(bad)
    before = rows(steps[0])
    assert all(before[i] == r for i, r in kept.items())


def test_line_dedup(steps):
    before, after = rows(steps[1]), rows(steps[2])
    assert all(r.n_chars == len(r.text) and r.text.strip() for r in after.values() if r.text != before[r.doc_id].text)
    whole = Counter(x for r in before.values() for x in set(r.text.split("\n")))
    left = Counter(x for r in after.values() for x in set(r.text.split("\n")))
    assert all(left[x] >= 1 for x in whole if x.strip())  # no line is lost altogether
    assert any(left[x] < n for x, n in whole.items())


def test_near_duplicates(steps):
    docs = [(r.doc_id, r.text) for r in steps[2].collect()]
    classes, links = brute(docs)
    want = {c if n else d[0] for d, c, n in zip(docs, classes, links, strict=True)}
    assert set(rows(steps[3])) == want


def test_mixing_keeps_a_prefix_of_each_leaf(steps):
    before, after = rows(steps[3]), rows(steps[4])
    assert all(before[i] == r for i, r in after.items()) and len(after) < len(before)
    words = lambda d: sum(len(r.text.split()) for r in d.values())
    # the documents at the edges of the leaves stay whole
    assert 0.85 * words(before) < words(after)


def test_packing(steps):
    tok = WordTokenizer(tokenizer_file())
    got = defaultdict(int)
    for r in steps[5].collect():
        got[r.doc_id] += r.length
    docs = rows(steps[4])
    assert got == {i: len(tok.full.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in docs.items()}


def test_run_gives_the_same(spark, steps):
    assert sorted(cp.run(spark, DIR).select("doc_id", "start").distinct().collect())[0] == sorted(
        steps[5].select("doc_id", "start").collect())[0]
    assert cp.run(spark, DIR).agg({"length": "sum"}).collect() == steps[5].agg({"length": "sum"}).collect()


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
