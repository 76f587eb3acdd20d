"""Budgets against a plain recursive version, prefixes against sorted lists."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shroud.llm.mixing import mix


def pour(budget, children):
    """{name: given}: repeatedly give by weight, and pass on what full children leave."""
    given, open_, left = {}, dict(children), budget
    while open_:
        total = sum(w for _, w in open_.values())
        full = {n: c for n, (c, w) in open_.items() if c * total <= left * w}
        if not full:
            return given | {n: left * w // total for n, (_, w) in open_.items()}
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        given[n] = full[n]
        left -= full[n]
        del open_[n]
    return given


def plan(docs, percent, lw, epochs):
    tokens = defaultdict(int)
    for _, text, *leaf in docs:
        tokens[tuple(leaf)] += len((text or "").split())
    tokens = {k: v for k, v in tokens.items() if v}
    out, total = {}, sum(tokens.values()) * percent // 100
    cap = lambda *p: sum(v for k, v in tokens.items() if k[: len(p)] == p) * epochs
    top = pour(total, {d: (cap(d), 100) for d in {k[0] for k in tokens}})
    for d, b in top.items():
        mid = pour(b, {x: (cap(d, x), lw.get(x, 100)) for x in {k[1] for k in tokens if k[0] == d}})
        for x, b2 in mid.items():
            low = pour(b2, {s: (cap(d, x, s), 100) for s in {k[2] for k in tokens if k[:2] == (d, x)}})
            out |= {(d, x, s): g for s, g in low.items()}
    return out, tokens


def expected(docs, percent, lw, epochs, seed=17):
    given, tokens = plan(docs, percent, lw, epochs)
    out = []
    for leaf, g in given.items():
        mine = [(i, len((t or "").split())) for i, t, *x in docs if tuple(x) == leaf]
        for e in range(g // tokens[leaf] + 1):
            left = g - e * tokens[leaf]
            key = lambda r, e=e: hashlib.md5(f"{seed}:{e}:{r[0]}".encode()).hexdigest()
            for i, n in sorted(mine, key=key):
                if n and left > 0:
                    out.append((i, e, min(n, left)))
                    left -= n
    return sorted(out)


def run(spark, docs, percent, lw, epochs):
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, text string, dom string, lang string, src string, tokens int")
    out = mix(df, F.col("dom"), F.col("lang"), F.col("src"), percent, language_weights=lw, max_epochs=epochs)
    return sorted(((r.doc_id, r.mx_epoch, r.mx_take) for r in out.collect()), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize(("percent", "epochs"), [(40, 1), (100, 2), (170, 4), (900, 3)])
def test_against_plain_version(spark, percent, epochs):
    rng = random.Random(percent)
    docs = [(i, "w " * rng.choice([0, 1, 5, 60]), rng.choice("AAB"), rng.choice(["en", "en", "de", "fr"]),
             "hot" if rng.random() < 0.4 else rng.choice("pqrs")) for i in range(300)]
    lw = {"en": 300, "de": 50}
    assert run(spark, docs, percent, lw, epochs) == expected(docs, percent, lw, epochs)


def test_shortage_goes_to_siblings_first(spark):
    docs = [(1, "w " * 10, "A", "en", "small"), (2, "w " * 500, "A", "en", "large"), (3, "w " * 1000, "B", "en", "x")]
    got = {i: n for i, _, n in run(spark, docs, 40, {}, 1)}
    assert got == {1: 10, 2: 292, 3: 302}


def test_edges(spark):
    docs = [(1, None, "A", "en", "s"), (2, "", "A", None, None), (3, "one two", None, None, None), (None, "x y z", "A", "en", "s"),
            (4, "w " * 100_000, "A", "en", "s"), (5, "a b", "A", "en", "s"), (5, "a b", "A", "en", "s")]
    got = run(spark, docs, 1000, {}, 1)
    assert sorted(map(str, got)) == sorted(map(str, [(3, 0, 2), (None, 0, 3), (4, 0, 100_000), (5, 0, 2), (5, 0, 2)]))
    assert run(spark, [], 50, {}, 2) == []
    with pytest.raises(ValueError):
        run(spark, docs, 50, {"en": 0}, 2)
