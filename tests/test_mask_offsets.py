"""Masking through the full fold (M1, M5), linear occurrence search (M5) and the sweep (M6): against brute force."""

import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from shroud.functions.arrays import once, running
from shroud.functions.fold import full_fold, special_folds
from shroud.operators.mask import apply_ranges_col, doc_items, mask_documents, merge_ranges_col, occurrences

LETTERS = ["a", "b", "J", "é", "é", "́", "ﬁ", "ﬃ", "№", "½", "한", "국", "ㅎ", "𝐉", "𝕠", "😀", "İ", "ß", " ", "Å", "①", "㎏"]


def nfkd(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_full_fold_of_every_character(spark):
    chars = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    lines = ["x" + "".join(chars[i : i + 500]) for i in range(0, len(chars), 500)]
    df = spark.createDataFrame([(t,) for t in lines], "t string").withColumn("f", special_folds("t")).select("t", full_fold(F.col("t"), F.col("f")).alias("k"))
    for r in df.collect():
        assert r.k == "".join(nfkd(c) for c in r.t)


def starred(text, items):
    """Each character's fold, every position of the joined folds tried for every item."""
    folds = [nfkd(c) for c in text]
    origin = [i for i, f in enumerate(folds) for _ in f]
    whole = "".join(folds)
    covered = set()
    for key in map(nfkd, items):
        for p in range(len(whole)):
            if key and whole.startswith(key, p):
                covered.update(range(origin[p], origin[p + len(key) - 1] + 1))
    return "".join("*" if i in covered else c for i, c in enumerate(text))


@pytest.mark.parametrize("max_inline", [512, 0])
def test_masking_equals_brute_force(spark, max_inline):
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, n)))
    cases = {str(i): (make(40), list({make(4) for _ in range(3)})) for i in range(150)}
    cases |= {"fi": ("ﬁne oﬃce", ["fin", "ffi"]), "no": ("see №5", ["No5"]), "ko": ("저는 한국 사람", ["한국", "사"]),
              "math": ("mr 𝐉ohn", ["John"]), "shift": ("½ ﬁ № José met José", ["José"]), "q": (r"a\Eb.*(x", [r"\E", ".*("])}
    chunks = spark.createDataFrame([(k, 0, t) for k, (t, _) in cases.items()], "doc_id string, chunk_index int, content string")
    items = spark.createDataFrame([(k, i) for k, (_, xs) in cases.items() for i in xs], "doc_id string, text string")
    got = {r.doc_id: r.content for r in mask_documents(chunks, doc_items(items), max_inline_items=max_inline).collect()}
    for k, (t, xs) in cases.items():
        assert got[k] == starred(t, xs), (t, xs)
    assert got["fi"] == "**e o*ce" and got["no"] == "see **" and got["ko"] == "저는 ** *람"


def test_occurrences(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("aab") for _ in range(rng.randrange(0, 30))), "".join(rng.choice("ab") for _ in range(rng.randrange(1, 4)))) for _ in range(200)]
    rows += [("aaaa", "aa"), ("", "a"), ("x.y.x", "."), (r"\E\Q\E", r"\E"), ("😀é😀", "😀")]
    df = spark.createDataFrame(rows, "t string, i string").select("t", "i", F.expr(occurrences("t", "i")).alias("p"))
    for r in df.collect():
        assert r.p == [k for k in range(len(r.t)) if r.t.startswith(r.i, k)]


def merged(ranges):
    out = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_and_apply(spark):
    rng = random.Random(5)
    cases = [[(s, s + rng.randrange(1, 9)) for s in (rng.randrange(40) for _ in range(rng.randrange(0, 20)))] for _ in range(150)]
    cases += [[], [(0, 1)], [(0, 2), (2, 4)], [(0, 50), (1, 2), (60, 61)]]
    text = "".join(rng.choice("xyé😀") for _ in range(70))
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, ranges array<struct<s:int,e:int>>").select(
        "i", merge_ranges_col("ranges").alias("m"), F.lit(text).alias("t"), "ranges").select("i", "m", apply_ranges_col("t", "ranges").alias("a"))
    for r in df.collect():
        want = merged(cases[r.i])
        assert [tuple(x) for x in r.m] == want
        assert r.a == "".join("*" if any(s <= k < e for s, e in want) else c for k, c in enumerate(text))


def test_running(spark):
    row = spark.range(1).select(F.expr(running("array(3, 1, 4, 1, 5, 9, 2)", "a + b")).alias("s"), F.expr(running("array(3, 1, 4, 1, 5)", "greatest(a, b)")).alias("m"),
                                F.expr(running("cast(array() as array<int>)", "a + b")).alias("z"), F.expr(once("id + 2", "v", "v * v")).alias("o")).first()
    assert (row.s, row.m, row.z, row.o) == ([3, 4, 8, 9, 14, 23, 25], [3, 3, 4, 4, 5], [], 4)


def test_many_ranges_and_items_in_one_chunk_take_no_quadratic_time(spark):
    def seconds(n):
        text = "ab-" * n
        df = spark.createDataFrame([("d", 0, text)], "doc_id string, chunk_index int, content string")
        items = spark.createDataFrame([("d", x) for x in ["ab", "b-a", *(f"zz{i}" for i in range(500))]], "doc_id string, text string")
        started = time.time()
        out = mask_documents(df, doc_items(items)).first().content
        assert out == "*" * (3 * n - 1) + "-"
        return time.time() - started

    seconds(10)
    small, large = seconds(10_000), seconds(80_000)
    assert large < 8 * 3 * max(small, 1.0)  # 8 times the text; a quadratic search would take 64 times as long
