"""Sharding by the weighted hash tree: against plain Python, its movement laws, gapless slots, edges."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shroud.llm import hash_tree
from shroud.llm.hash_tree import Shard, Tree, moves, place, shard_of, slots

WEIGHTED = Tree([Shard("a", "x", 0, 1), Shard("a", "x", 1, 3), Shard("a", "y", 2, 2), Shard("b", "x", 3, 5),
                 Shard("b", "z", 4, 0), Shard("c", "x", 5, 1), Shard("c", "x", 6, 1), Shard("c", "w", 7, 2)])


def plain_shard(tree, key):
    path, level = "/", [s for s in tree.shards]
    for name in (lambda s: s.region, lambda s: s.rack, lambda s: str(s.shard)):
        weight = Counter()
        for s in level:
            weight[name(s)] += s.weight
        best = min((-math.log((int(hashlib.md5(f"{path}{n}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w, n)
                   for n, w in weight.items())[1]
        level, path = [s for s in level if name(s) == best], f"{path}{best}/"
    return level[0].shard


@pytest.mark.parametrize("tree", [WEIGHTED, Tree.even(8), Tree.even(13, 3, 2)])
def test_descent(spark, tree):
    got = {r.id: r.shard for r in place(spark.range(600), tree, "id").collect()}
    assert got == {i: plain_shard(tree, i) for i in range(600)}


def test_shares_follow_weights(spark):
    got = dict(place(spark.range(30_000), WEIGHTED, "id").groupBy("shard").count().collect())
    assert 4 not in got
    for s in WEIGHTED.shards:
        assert got[s.shard] == pytest.approx(30_000 * s.weight / 15, rel=0.1)


def test_new_region_takes_rows_only_into_itself(spark):
    old = Tree.even(8)
    for new in (old.with_region(8), WEIGHTED.with_region(9, 4.0)):
        base = old if new.shards[0].region == "g0" else WEIGHTED
        moved = moves(spark.range(5_000), base, new, "id").collect()
        assert moved and {r.to_shard for r in moved} == {new.shards[-1].shard}


def test_movement_stays_on_the_path_of_the_change(spark):
    where = {s.shard: (s.region, s.rack) for s in WEIGHTED.shards}
    for r in moves(spark.range(5_000), WEIGHTED, WEIGHTED.reweighted(2, 6.0), "id").collect():
        old, new = where[r.from_shard], where[r.to_shard]
        assert new[0] == "a"  # the region that grew
        if old[0] == "a":
            assert old[1] != new[1] and new[1] == "y"  # and within it the rack that grew
    drained = moves(spark.range(5_000), WEIGHTED, WEIGHTED.reweighted(3, 0), "id").collect()
    assert {r.from_shard for r in drained} == {3}


def test_trees_are_checked():
    for bad in ([], [Shard("a", "b", 1, 0)], [Shard("a", "b", 1), Shard("c", "b", 1)], [Shard("a", "b", 1, -1)],
                [Shard("a", "b", 1, float("inf"))], [Shard("a/b", "b", 1)]):
        with pytest.raises(ValueError):
            Tree(bad)


def numbered(rows, columns, tree):
    return slots(rows, columns, shard_of(tree, F.col(columns[0]))).collect()


def check_slots(got, want_rows):
    assert Counter(r[:-2] for r in map(tuple, got)) == want_rows
    for shard, n in Counter(r.shard for r in got).items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_slots_with_hot_keys_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hash_tree, "REPEATS", 50)
    rows = [(i, i % 7, i) for i in range(900)] + [(5, 1, 1)] * 777 + [(None, i % 3, i) for i in range(400)] + [(None, 1, None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, size long, text_crc32 long").repartition(7)
    got = numbered(df, ["doc_id", "size", "text_crc32"], Tree.even(8))
    check_slots(got, Counter(rows))
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    again = numbered(df.repartition(3), ["doc_id", "size", "text_crc32"], Tree.even(8))
    assert sorted(map(str, again)) == sorted(map(str, got))  # whatever the partitions
    with pytest.raises(ValueError):
        slots(df.withColumn("slot", F.lit(1)), ["slot"], F.lit(1))


def test_query_edges(spark, tmp_path):
    from shroud.llm.registry import QUERIES

    texts = [(1, "a"), (2, None), (3, ""), (3, ""), (None, "é" * 10), (4, "x" * 300_000), (9_223_372_036_854_775_807, "b")]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in texts], "doc_id long, text string, slot int, shard string")
    df.write.parquet(str(tmp_path / "a/documents.parquet"))
    got = QUERIES["op11_hash_tree"](spark, str(tmp_path / "a")).collect()
    data = [(i, (t or "").encode()) for i, t in texts]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in data)
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    check_slots([r for r in spark.createDataFrame(got).select("doc_id", "size", "text_crc32", "shard", "slot").collect()],
                Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in data))
    df.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert QUERIES["op11_hash_tree"](spark, str(tmp_path / "b")).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hash_tree.write_shards(docs, WEIGHTED, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count()
    assert place(back.drop("shard"), WEIGHTED).join(back.select("doc_id", F.col("shard").alias("was")), "doc_id").filter("shard <> was").count() == 0


def test_plan_has_no_python(spark):
    from shroud.llm.registry import QUERIES

    plan = QUERIES["op11_hash_tree"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
