"""Quality classifier with hierarchical empirical Bayes priors (operator 9).

A logistic model over surface features of the whole text gives the evidence of
one document. Sites give the prior: the soft counts of all documents are summed
per path (host and path columns) by grouped aggregation, host means are shrunk
toward the global mean and path means toward their host's, each with a prior
strength estimated from the spread between groups (method of moments), so a
site with few documents stays near its parent. A document's log odds are its
evidence, less the base rate the model was trained at, plus its path's.

The model is fitted in numpy on at most ``max_labels`` labelled documents (those
with the smallest hash of doc_id; that many rows come to the driver). All other
counts cover all rows. The path table is broadcast only after its rows are
counted; beyond the bound it is a shuffle join.

Defined results: a null text is an empty text; null host or path columns are a
site of their own; repeated rows count as often as they occur and get equal
scores; labels that are null or of unknown documents are ignored, several
labels of a document count with their least; with no labels at all, or an empty
table, the evidence is 0 and everything is kept; other columns are kept as they
are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm import textscan as ts
from shroud.llm.common import materialize, python_workers, set_aside, small_side

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "bang": b"!?",
    "bar": b"|",
    "noise": b"#$%&*+/<=>@\\^_`{}~",
    "stop": b".,;:",
    "line": b"\n",
}
FEATURES = ["log_chars", *_CLASSES, "wide", "word_length", "same_as_last", "distinct", "phrases", "short_words"]


def text_features(col: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    buf, off = ts.text_buffers(col)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    for lo, hi in ts.parts(off):
        out[lo:hi] = _part_features(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
    return out


def _part_features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    size = np.diff(off)
    chars = np.maximum(size, 1)
    full = np.flatnonzero(size)
    code = np.full(256, len(_CLASSES) + 1, np.uint8)
    for i, members in enumerate(_CLASSES.values()):
        code[list(members)] = i
    code[128:] = len(_CLASSES)
    kinds = code[raw]
    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log(chars)
    for i in range(len(_CLASSES) + 1):
        if len(full):
            out[full, 1 + i] = np.add.reduceat((kinds == i).astype(np.int32), off[full]) / chars[full]
    s, e, doc = ts.tokens(raw, off)
    if not len(s):
        return out
    h = ts.token_hashes(raw, s, e)
    words = np.bincount(doc, minlength=n)
    per = np.maximum(words, 1)
    k = 2 + len(_CLASSES)
    out[:, k] = np.log1p(np.bincount(doc, weights=e - s, minlength=n) / per)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, k + 1] = np.bincount(doc[1:], weights=same, minlength=n) / per
    out[:, k + 2] = _distinct(h, doc, n) / per
    g, bounds = ts.shingles(h, doc, n, 5)
    number = np.diff(bounds)
    out[:, k + 3] = _distinct(g, np.repeat(np.arange(n), number), n) / np.maximum(number, 1)
    out[:, k + 4] = np.bincount(doc, weights=(e - s) <= 3, minlength=n) / per
    return out


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    key = np.sort(ts.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                  | doc.astype(np.uint64) << np.uint64(40))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=n)


def expand(x: np.ndarray) -> np.ndarray:
    """Features with squares and square roots, so that a linear model can bend."""
    return np.hstack([x, x * x, np.sqrt(np.abs(x))])


@dataclass(frozen=True)
class LogisticModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float  # log odds of the training labels

    def evidence(self, features: np.ndarray) -> np.ndarray:
        z = (expand(features) - self.mean) / self.scale
        return np.clip(z @ self.weights[1:] + self.weights[0], -30, 30) - self.base


def fit_logistic(features: np.ndarray, label: np.ndarray, ridge: float = 1.0, steps: int = 30) -> LogisticModel:
    """Ridge logistic regression by Newton steps."""
    x = expand(features)
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    share = (label.sum() + 1) / (len(label) + 2)
    base = math.log(share / (1 - share))
    w = np.zeros(z.shape[1])
    w[0] = base
    if not len(x) or label.min() == label.max():
        return LogisticModel(mean, scale, w, base)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - label) + ridge * np.r_[0, w[1:]]
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return LogisticModel(mean, scale, w, base)


#: Columns that ``classify`` adds.
ADDED = ("qe_evidence", "host_share", "path_share", "p_quality", "keep")


def train(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000) -> LogisticModel:
    python_workers(docs.sparkSession)
    sample = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("qe_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )

    def features(batches):
        for b in batches:
            x = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.list_(pa.float64())), b.column("qe_label")], names=["x", "qe_label"])

    # one text for each id, however often the table repeats it: at most max_labels rows come to the driver
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "qe_label").agg(
        F.min("text").alias("text"))
    rows = texts.select("text", "qe_label").mapInArrow(
        features, "x array<double>, qe_label int").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit_logistic(x, rows["qe_label"].to_numpy(float))


def with_evidence(docs: DataFrame, model: LogisticModel) -> DataFrame:
    """``docs`` with qe_evidence, the log odds that the text alone adds."""
    python_workers(docs.sparkSession)

    @F.arrow_udf("double")
    def evidence(text: pa.Array) -> pa.Array:
        return pa.array(model.evidence(text_features(text)), pa.float64())

    # never null, so that no filter on null evidence is inferred, which would run the function a second time
    return docs.withColumn("qe_evidence", F.coalesce(evidence(F.col("text")), F.lit(0.0)))


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _shrunk(groups: DataFrame, total: Column, n: Column, parent: Column, strength: float) -> Column:
    return (total + F.lit(strength) * parent) / (n + F.lit(strength))


def _strength(groups: DataFrame, mean: Column, parent: Column, n: Column) -> float:
    """Prior strength from the spread of group means around their parents' (method of moments)."""
    noise = parent * (1 - parent)
    r = groups.agg(
        F.sum(n * (mean - parent) ** 2).alias("spread"), F.sum(noise).alias("noise"),
        F.sum(n).alias("n"), F.avg(noise).alias("v"), F.count(F.lit(1)).alias("g"),
    ).first()
    if not r["g"] or r["g"] < 2:
        return 1.0
    between = max((r["spread"] - r["noise"]) / r["n"], 1e-9)
    return float(min(max(r["v"] / between - 1, 1.0), 1e6))


def site_posteriors(scored: DataFrame, host: str, path: str, model: LogisticModel) -> DataFrame:
    """One row per (host, path): shrunk shares of good documents of the host and of the path."""
    soft = 1 / (1 + F.exp(-(F.col("qe_evidence") + F.lit(model.base))))
    paths = materialize(
        scored.groupBy(_site(host).alias("qe_host"), _site(path).alias("qe_path"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(soft).alias("s")), "quality-paths")
    hosts = paths.groupBy("qe_host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = (total["s"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    grand = F.lit(float(mean))
    k_host = _strength(hosts, F.col("hs") / F.col("hn"), grand, F.col("hn"))
    hosts = hosts.withColumn("host_share", _shrunk(hosts, F.col("hs"), F.col("hn"), grand, k_host))
    both = paths.join(hosts, "qe_host")
    k_path = _strength(both, F.col("s") / F.col("n"), F.col("host_share"), F.col("n"))
    both = both.withColumn("path_share", _shrunk(both, F.col("s"), F.col("n"), F.col("host_share"), k_path))
    return materialize(both.select("qe_host", "qe_path", "host_share", "path_share"), "quality-sites")


def _site(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\0null"))


def with_quality(scored: DataFrame, sites: DataFrame, host: str, path: str, threshold: float = 0.5) -> DataFrame:
    """``scored`` with host_share, path_share, p_quality and keep."""
    joined = scored.withColumn("qe_host", _site(host)).withColumn("qe_path", _site(path)).join(
        small_side(sites), ["qe_host", "qe_path"], "left")
    p = 1 / (1 + F.exp(-(F.col("qe_evidence") + _odds(F.col("path_share")))))
    return (joined.withColumn("p_quality", p).withColumn("keep", F.col("p_quality") >= threshold)
            .drop("qe_host", "qe_path"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
             max_labels: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """``docs`` with the columns of ``ADDED``, which replace input columns of these names."""
    docs, back = set_aside(docs.drop(*[c for c in ADDED if c not in (host, path)]), lambda c: c in ("qe_host", "qe_path"))
    model = train(docs, labels, max_labels)
    scored = with_evidence(docs, model)
    return back(with_quality(scored, site_posteriors(scored, host, path, model), host, path, threshold))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
                   max_labels: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, evidence, host_share, path_share, p_quality, keep) of every row; the texts are read once."""
    model = train(docs, labels, max_labels)
    light = materialize(
        with_evidence(docs.select("doc_id", host, path, "text"), model).drop("text"), "quality-evidence")
    out = with_quality(light, site_posteriors(light, host, path, model), host, path, threshold)
    return out.select("doc_id", F.col("qe_evidence").alias("evidence"), "host_share", "path_share", "p_quality", "keep")
