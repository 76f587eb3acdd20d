"""The quality classifier: held-out accuracy, shrinkage, and its defined results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shroud.llm import quality as q

DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    half = F.xxhash64("doc_id") % 2 == 0
    scored = q.quality_scores(docs, labels.filter(half)).join(labels.filter(~half), "doc_id").toPandas()
    good = scored["quality"] == 1
    assert (scored["keep"] == good).mean() > 0.97
    assert scored["keep"][good].mean() > 0.98


def test_features_do_not_depend_on_batches():
    texts = ["A b!! c", None, "", "x | y\nz " * 50, "é ñ 12 ###", "w"]
    whole = q.text_features(pa.array(texts))
    each = np.vstack([q.text_features(pa.array([t], pa.string())) for t in texts])
    np.testing.assert_allclose(whole, each)
    assert whole[3, q.FEATURES.index("distinct")] == pytest.approx(2 * 3 / 300, abs=0.02)


def test_sparse_sites_stay_near_their_parents(spark):
    model = q.LogisticModel(np.zeros(1), np.ones(1), np.zeros(2), 0.0)
    rows = [("big", "a", 3.0)] * 400 + [("big", "b", -3.0)] * 400 + [("bad", "a", -3.0)] * 300 + [("bad", "c", 3.0)] + [("one", "a", 3.0)]
    sites = {(r.qe_host, r.qe_path): r for r in q.site_posteriors(
        spark.createDataFrame(rows, "host string, path string, qe_evidence double"), "host", "path", model).collect()}
    assert sites["bad", "a"].host_share < 0.15 < 0.4 < sites["big", "a"].host_share < 0.6
    assert sites["big", "a"].path_share > 0.85 and sites["big", "b"].path_share < 0.15
    # one good document moves its path less than 400 do
    assert sites["bad", "c"].path_share < sites["big", "a"].path_share
    assert sites["one", "a"].host_share < 0.95


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "s", "en", 0.5), (2, "", None, None, 0.5), (2, "", None, None, 0.5), (3, "word " * 200_000, "s", "en", 0.5),
         (None, "a b c", "s", None, 0.5)], "doc_id long, text string, source string, lang string, p_quality double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = q.classify(docs.drop("p_quality"), none).collect()
    assert len(out) == 5 and all(r.keep and r.qe_evidence == 0 for r in out)
    odd = spark.createDataFrame([(None, 1), (1, None), (77, 1), (3, 0), (3, 1)], "doc_id long, quality int")
    assert q.quality_scores(docs, odd).count() == 5
    assert q.quality_scores(docs.limit(0), odd).collect() == []
