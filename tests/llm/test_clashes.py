"""Input columns that are named as the operators' own, and many rows of one labelled id."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from shroud.llm import quality
from shroud.llm.common import materialize, set_aside, table
from shroud.llm.line_dedup import dedup_lines

DIR = "/root/testdata/sf0.001"
NAMES = ["path_share", "host_share", "keep", "qe_evidence", "qe_host", "qe_path", "p_quality", "dd_key", "dd_ord", "dd_blocks", "n_lines",
         "n_deleted", "mx_domain", "mx_tokens", "mx_order", "class_id", "h", "label", "i", "set_aside_5", "a.b"]


@pytest.fixture(scope="module")
def clashing(spark):
    docs = table(spark, DIR, "documents").filter("doc_id < 90")
    return materialize(docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in NAMES]), "clashing")


def test_stages_keep_columns_of_any_name(spark, clashing):
    plain = clashing.select(*cp.OWN)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, clashing, DIR)
        assert got.columns == clashing.columns, name
        rows = got.collect()
        assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, stage(spark, plain, DIR).collect())), name
        assert all(tuple(r)[5:] == tuple(f"{n} {r.doc_id}" for n in NAMES) for r in rows), name


def test_operators_keep_columns_of_any_name(spark, clashing):
    got = dedup_lines(clashing).collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in NAMES if n not in ("n_lines", "n_deleted"))
    labels = table(spark, DIR, "labels")
    got = quality.classify(clashing, labels).collect()
    want = {r.doc_id: r.keep for r in quality.quality_scores(clashing.select(*cp.OWN), labels).collect()}
    assert {r.doc_id: r.keep for r in got} == want
    assert all(r[n] == f"{n} {r.doc_id}" for r in got for n in NAMES if n not in quality.ADDED)


def test_set_aside(spark):
    df, back = set_aside(spark.range(1).select("id", F.lit(1).alias("x"), F.lit(2).alias("a.b")), lambda c: c != "id")
    assert "x" not in df.columns and back(df).columns == ["id", "x", "a.b"]


def test_one_text_for_each_labelled_id(spark, monkeypatch):
    docs = spark.range(3_000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("some text "), F.col("id")).alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    seen = []
    real = quality.fit_logistic
    monkeypatch.setattr(quality, "fit_logistic", lambda x, y, *a, **k: (seen.append(len(x)), real(x, y, *a, **k))[1])
    quality.train(docs, labels, max_labels=2)
    assert seen == [2]
