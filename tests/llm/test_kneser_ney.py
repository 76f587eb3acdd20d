"""The model against a plain dictionary version, and its probabilities summing to 1."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shroud.llm import kneser_ney as kn

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return (text or "").encode().translate(LOWER).split() + ["</s>"]


class Plain:
    def __init__(self, texts):
        self.c2, self.c1 = Counter(), Counter()
        for t in texts:
            prev = "<s>"
            for w in toks(t):
                self.c2[prev, w] += 1
                self.c1[w] += 1
                prev = w
        self.total, self.before, self.follow = Counter(), Counter(), defaultdict(Counter)
        for (v, w), n in self.c2.items():
            self.total[v] += n
            self.before[w] += 1
            self.follow[v][min(n, 3)] += 1
        self.d2 = self.discounts(Counter(self.c2.values()))
        self.d1 = self.discounts(Counter(self.before.values()))
        self.spare = sum(self.d1[min(n, 3)] for n in self.before.values())

    @staticmethod
    def discounts(n):
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i) if n[i] else 0 for i in (1, 2, 3)]

    def p(self, v, w):
        types = len(self.c2)
        b = self.before[w]
        low = 1 / (len(self.c1) + 1)
        if types:
            low = (b - self.d1[min(b, 3)]) / types + self.spare / types * low
        if not self.total[v]:
            return low
        c = self.c2[v, w]
        spare = sum(self.d2[i] * n for i, n in self.follow[v].items())
        return (c - self.d2[min(c, 3)]) / self.total[v] + spare / self.total[v] * low

    def score(self, text):
        prev, out = "<s>", 0.0
        for w in toks(text):
            out += math.log10(self.p(prev, w))
            prev = w
        return out


def compare(rows, docs):
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    plain = Plain([t for i, t in docs if not held[i]])
    n, v = sum(plain.c1.values()), len(plain.c1)
    want = []
    for i, t in docs:
        words = toks(t)
        base = sum(math.log10((plain.c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((i, held[i], len(words), sum(plain.c1[w] > 0 for w in words), n, base, plain.score(t)))
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    got = sorted((tuple(r) for r in rows), key=key)
    want.sort(key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    return plain


def run(docs):
    held_out = kn.held_out_tenth(F.col("doc_id"))
    model = kn.train(docs.filter(~held_out))
    return kn.score(docs, model, held_out).collect(), model


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows, _ = run(docs)
    plain = compare(rows, [tuple(r) for r in docs.collect()])
    for v in ["<s>", b"the", b"never-seen"]:
        assert sum(plain.p(v, w) for w in [*plain.c1, "unknown"]) == pytest.approx(1)


def test_many_flushes_and_shards(spark, monkeypatch):
    monkeypatch.setattr(kn, "SHARD_BYTES", 1000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows, model = run(docs)
    assert model.shard_bits > 5
    compare(rows, [tuple(r) for r in docs.collect()])


def test_edges(spark):
    data = [(1, None), (2, ""), (2, ""), (3, "  \t\n"), (4, "A a B"), (None, "a b a b"), (5, "é É \x85x"),
            (6, "w " * 70_000), (7, "w " * 70_000), (8, "a b"), (9, "a b")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, held_out int")
    rows, _ = run(docs)
    compare(rows, data)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows, model = run(docs)
    assert rows == [] and model.stats["tokens"] == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = kn.score(one, model, F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_scores_are_finite_where_counts_of_counts_are_missing(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(5)], "doc_id long, text string")
    model = kn.train(docs)
    texts = ["a c b", "a z", "a b c", "", "z z z", "c b a"]
    rows = kn.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, F.lit(True)).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_a_lost_file_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"w{i} x y") for i in range(30)], "doc_id long, text string")
    model = kn.train(docs, str(tmp_path / "m"))
    assert sorted(p.name for p in (tmp_path / "m/bigrams").iterdir()) == sorted(map(str, range(8)))
    assert sorted(p.name for p in (tmp_path / "m/words").iterdir()) == sorted(map(str, range(8)))
    (tmp_path / "m/bigrams").rename(tmp_path / "m/gone")
    with pytest.raises(Exception, match="No such file"):
        kn.score(docs, model, F.lit(True)).collect()


def test_more_shards_than_open_maps(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    few = kn.score(docs, kn.train(docs), F.lit(False)).collect()
    model = kn.train(docs, shard_bytes=100, max_maps=3)
    assert model.shard_bits >= 6
    many = kn.score(docs, model, F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in few) == sorted((r.doc_id, r.n_known, round(r.score, 9)) for r in many)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    buf, off = kn.ts.text_buffers(__import__("pyarrow").array([t for _, t in rows]))
    before, word, _ = kn.bigrams(buf, off)
    model.score(before, word)
    assert len(model._open) <= 3
