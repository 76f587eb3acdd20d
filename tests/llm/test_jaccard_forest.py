"""The join against all pairs computed in plain Python."""

import random
from collections import Counter, defaultdict

from shroud.llm import jaccard_forest as jf
from shroud.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """(class of each row, links of each row) by comparing all rows that share a run of words."""
    sets = [shingle_set(t) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links, parent = Counter(), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x] if j > i).items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(j)] = root(i)
    ids = defaultdict(list)
    for i in range(len(docs)):
        ids[root(i)].append(docs[i][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return [least[root(i)] for i in range(len(docs))], [links[i] for i in range(len(docs))]


def check(spark, docs, **options):
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, class_id int")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jf.jaccard_join(df, **options).collect()), key=str)
    classes, links = brute(docs)
    assert got == sorted(((d[0], c, n) for d, c, n in zip(docs, classes, links, strict=True)), key=str)
    kept = jf.drop_near_duplicates(df, **options)
    assert kept.columns == df.columns
    rows = kept.collect()
    # one row of every group, all rows that link to nothing
    groups = Counter(c if n else ("alone", k) for k, (c, n) in enumerate(zip(classes, links, strict=True)))
    assert len(rows) == len(groups)
    return rows


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(900)) for _ in range(n)]


def test_near_copies(spark):
    rng, docs = random.Random(3), []
    for g in range(12):
        base = words(rng, rng.choice([6, 40, 200]))
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            docs.append((len(docs), " ".join(w) if g % 2 else "  ".join(w).upper()))
    rows = check(spark, docs, block=8)
    assert len(rows) < len(docs)


def test_edges(spark):
    long = " ".join(words(random.Random(1), 60_000))
    docs = [(1, None), (2, None), (3, ""), (4, " \n\t"), (5, "a b"), (6, "A  b"), (6, "A  b"), (None, "a b"), (7, "a"),
            (8, long), (9, long + " end"), (10, "x y z w v"), (11, "v w z y x")]
    check(spark, docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jf.jaccard_join(df).collect() == [] and jf.drop_near_duplicates(df).collect() == []


def test_prefix_lengths():
    assert jf.prefix_depths(0.8, 20, 8, 0.9999) == [8, 4]
    assert jf.prefix_depths(0.8, 1, 8, 0.9999) == [8, 4, 2, 1]


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
