"""Line dedup on planted blocks, and its bookkeeping on real documents."""

import random

from shroud.llm.line_dedup import dedup_lines, longest_chain


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_lines int")
    out = dedup_lines(df, **options)
    assert sorted(out.columns) == ["doc_id", "n_deleted", "n_lines", "text"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_deleted) for r in out.collect()), key=str)


def lines(tag, n):
    return [f"{tag} line {i} with some words of its own so that it is long enough" for i in range(n)]


def test_blocks_go_from_the_later_document(spark):
    passage = lines("passage", 6)
    a = lines("a", 4) + passage + lines("a2", 3)
    b = lines("b", 2) + passage + lines("b2", 2)
    c = passage[2:] + lines("c", 1)
    got = {r[0]: r for r in run(spark, [(1, "\n".join(a)), (2, "\n".join(b)), (3, "\n".join(c))])}
    assert got[1][1] == "\n".join(a) and got[1][3] == 0
    assert got[2][1] == "\n".join(lines("b", 2) + lines("b2", 2)) and got[2][2:] == (10, 6)
    assert got[3][1] == "\n".join(lines("c", 1)) and got[3][3] == 4


def test_gaps_between_anchors_are_part_of_a_block(spark):
    block = [lines("x", 1)[0], "", "ok", "ok", "", lines("y", 1)[0]]
    other = [lines("x", 1)[0], "", "ok", "no", "", lines("y", 1)[0]]
    got = {r[0]: r for r in run(spark, [(1, "\n".join(block)), (2, "\n".join(["head", *block, "tail"])), (3, "\n".join(other))])}
    assert got[2][1] == "head\ntail"
    assert got[3][1] == "\nok\nno\n" and got[3][3] == 2


def test_moved_lines_align_by_the_longest_chain(spark):
    p = lines("p", 5)
    moved = [p[4], p[0], p[1], p[2], p[3]]
    got = {r[0]: r for r in run(spark, [(1, "\n".join(p)), (2, "\n".join(moved))])}
    assert got[2][1] == p[4]


def test_repeated_passages(spark):
    """A passage that either document repeats goes as often as the earlier one holds it, in whatever order."""
    p, q = lines("p", 3), lines("q", 3)
    a = [*p, *lines("a", 1), *p]
    assert run(spark, [(1, "\n".join(a)), (2, "\n".join(["head", *p, "tail"]))])[1][1] == "head\ntail"
    assert run(spark, [(1, "\n".join(a)), (2, "\n".join([*p, "mid", *p, "tail"]))])[1][1] == "mid\ntail"
    assert run(spark, [(1, "\n".join(p)), (2, "\n".join([*p, "mid", *p]))])[1][3] == 3
    assert run(spark, [(1, "\n".join(q + p)), (2, "\n".join(p + q + p))])[1][1] == "\n".join(p)
    assert run(spark, [(1, "\n".join(p + q + p)), (2, "\n".join([*q, *p, "tail"]))])[1][1] == "tail"


def test_short_lines_with_holders_of_their_own(spark):
    """A block goes whole if one earlier document holds it, though each of its lines has an earlier holder."""
    block = [f"short line {i}" for i in range(6)]
    rows = [(i, f"{x}\nother words {i}") for i, x in enumerate(block)]
    rows += [(10, "\n".join(["ten", *block, "ten again"])), (11, "\n".join(["first", *block[:4], "", *block[4:], "tail"])),
             (12, "\n".join(["head", *block, "tail"]))]
    got = {r[0]: r for r in run(spark, rows)}
    assert all(got[i][3] == 0 for i in range(6)) and got[10][3] == 0
    assert got[12][1] == "head\ntail" and got[12][3] == 6
    assert got[11][1] == "\n".join(["first", "", *block[4:], "tail"])


def test_many_copies(spark):
    text = "\n".join(lines("copy", 5))
    got = run(spark, [(i, text) for i in range(200)])
    assert [r[3] for r in sorted(got)] == [0] + [5] * 199
    assert all(r[1] == "" for r in sorted(got)[1:])


def test_short_lines_stay(spark):
    rows = [(1, "Ti.\nalone here"), (2, "Ti.\nother there"), (3, "Ti.")]
    assert [r[1] for r in run(spark, rows)] == ["Ti.\nalone here", "Ti.\nother there", "Ti."]


def test_edges(spark):
    long = "\n".join(lines("long", 20_000))
    copy = lines("dup", 1)[0]
    got = run(spark, [(1, None), (2, ""), (3, "\n\n"), (4, copy), (4, copy), (None, copy), (5, long), (6, long + "\nmore")])
    assert (1, None, 0, 0) in got and (2, "", 1, 0) in got and (3, "\n\n", 3, 0) in got
    assert got.count((4, copy, 1, 0)) == 2  # equal rows are one document
    assert (None, "", 1, 1) in got and (6, "more", 20_001, 20_000) in got


def test_empty_table(spark):
    assert run(spark, []) == []


def test_documents(spark):
    """Lines that are left keep their order; what goes is in an earlier document; the first holder keeps a line."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: r.text for r in docs.collect()}
    gone = 0
    for r in dedup_lines(docs).collect():
        old, new = before[r.doc_id].split("\n"), r.text.split("\n") if r.n_deleted < r.n_lines else []
        assert len(old) - len(new) == r.n_deleted
        rest = iter(old)
        assert all(any(x == y for y in rest) for x in new)
        earlier = {x for i, t in before.items() if i < r.doc_id for x in t.split("\n")}
        left = list(new)
        for x in old:
            if x in left:
                left.remove(x)
            else:
                assert x in earlier
                gone += 1
    assert gone


def test_longest_chain():
    rng = random.Random(5)
    for _ in range(200):
        v = rng.sample(range(30), rng.randrange(9))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] += max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        chain = [v[i] for i in longest_chain(v)]
        assert len(chain) == max(best, default=0) and chain == sorted(chain)
