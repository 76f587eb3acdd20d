"""Listing in tasks (S1-S6): every name, os.walk's files, ids in order, nothing but the listing shuffled."""

import os

import pytest
from pyspark.sql import functions as F

from shroud.sources import walk as W
from shroud.sources.files import extract_documents, list_files, load_directory


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    names = ["_a.txt", ".b.txt", "c.txt", "sub/_d.md", "sub/.hidden/e.txt", "_dir/deep/f.TXT", "sub/with space/ü.txt", "z/.g", "sub/x=1/h.txt",
             *(f"many/{i % 7}/{i}.txt" for i in range(90))]
    for i, name in enumerate(names):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x" * i)
    (root / "empty").mkdir()
    os.symlink(root / "c.txt", root / "link.txt")
    os.symlink(root / "sub", root / "linked_dir")
    os.symlink(root / "gone", root / "broken.txt")
    return str(root)


def walked(root):
    return sorted("file:" + os.path.join(d, f) for d, _, names in os.walk(root) for f in names)


@pytest.mark.parametrize("budget", [1, 5, 20_000])
def test_recursive_listing_equals_os_walk(spark, tree, budget):
    got = W.walk(spark, "file:" + tree, True, budget).collect()
    links = {"file:" + tree + "/linked_dir"}
    assert sorted(r.path for r in got) == [p for p in walked(tree) if p not in links]
    for r in got:
        if "broken" in r.path:
            assert r.length is None
        else:
            s = os.stat(r.path[5:])
            assert r.length == s.st_size and abs(r.modificationTime.timestamp() - s.st_mtime) < 1e-3


def test_flat_listing_opens_one_directory(spark, tree, monkeypatch):
    got = sorted(r.filename for r in list_files(spark, tree).collect())
    assert got == [".b.txt", "_a.txt", "broken.txt", "c.txt", "link.txt"]


def test_ids_are_positions_of_the_sorted_listing(spark, tree):
    rows = {r.path: int(r.file_id) for r in list_files(spark, tree, recursive=True).collect()}
    want = [p for p in walked(tree) if "linked_dir" not in p]
    assert rows == {p: i for i, p in enumerate(want)}
    sized = [p for p in want if "broken" not in p and p.lower().endswith(".txt") and os.path.getsize(p[5:]) <= 20]
    rows = {r.path: int(r.file_id) for r in list_files(spark, tree, recursive=True, extensions=["txt"], max_mb=20 / 2**20, sort_by="size", id_start=1).collect()}
    assert rows == {p: i + 1 for i, p in enumerate(sorted(sized, key=lambda p: (os.path.getsize(p[5:]), p)))}


def test_hidden_names_are_loaded_and_bad_files_stay_alone(spark, tree):
    env, rejects = load_directory(spark, tree)
    got = {r.file.filename: r.file for r in env.collect()}
    assert sorted(got) == [".b.txt", "_a.txt", "c.txt", "link.txt"]
    assert [got[n].id for n in sorted(got)] == ["0", "1", "3", "4"]
    assert got["c.txt"].data.content == "xx" and got["_a.txt"].data.content == ""
    assert [(os.path.basename(r.path), r.error[:17]) for r in rejects.collect()] == [("broken.txt", "FileNotFoundError")]
    held = {r.filename: r.content for r in list_files(spark, tree, with_content=True).collect()}
    assert held["c.txt"] == b"xx" and held["broken.txt"] is None


def test_large_files_are_split_over_batches(spark, tmp_path, monkeypatch):
    for i in range(12):
        (tmp_path / f"{i}.txt").write_bytes(bytes([65 + i]) * 5_000_000)
    files = list_files(spark, str(tmp_path))
    held = list_files(spark, str(tmp_path), with_content=True)
    assert sorted(r.n for r in held.select(F.length("content").alias("n")).collect()) == [5_000_000] * 12
    ok, _ = extract_documents(files.coalesce(1))
    assert sorted(r.c for r in ok.select(F.substring("text", 4_999_999, 2).alias("c")).collect()) == [chr(65 + i) * 2 for i in range(12)]


def test_content_is_not_shuffled(spark, tree):
    ok, _ = extract_documents(list_files(spark, tree, recursive=True))
    plan = ok._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Repartition" not in above and "Join" not in above
    assert "content" not in plan[plan.index("MapInArrow"):]


def test_missing_directories_and_plain_files(spark, tree):
    assert list_files(spark, tree + "/nowhere").collect() == []
    assert list_files(spark, tree + "/c.txt").collect() == []
    assert list_files(spark, tree + "/empty", recursive=True, with_content=True).collect() == []
    assert W.local_path("file:/a b") == "/a b" and W.local_path("file:///a") == "/a" and W.local_path("s3://x/y") is None
    assert W.local_path("/a:b") == "/a:b" and not W.reachable("viewfs://store/x")
