"""Files at size: a written folder is emptied by the tasks, a task holds few texts at once, few steps for a blank in an .odt."""

import glob
import os
import sys

from pyspark.sql import functions as F

from shroud.operators.partitioning import save_table
from shroud.plans import file_queries as Q
from shroud.sources.files import extract_documents, list_files
from shroud.sources.parts import odt_text


def left_in(folder):
    return [f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names if not f.endswith(".crc")]


def test_the_driver_removes_no_file(spark, monkeypatch):
    rows = spark.range(40).select(F.concat(F.lit("a/"), (F.col("id") % 3).cast("string"), F.lit("/"), (F.col("id") % 39).cast("string"), F.lit(".txt")).alias("name"),
                                  F.lit("x").alias("text"))
    base = Q.write_folder(rows, lambda text: text.encode())
    assert len(left_in(base)) == 39
    seen = []
    drop = Q.drop_folder
    monkeypatch.setattr(Q, "drop_folder", lambda s, folder: (seen.append(left_in(folder)), drop(s, folder)))
    out = Q.result(list_files(spark, base, recursive=True, id_mode="hash").select("filename"), base, rows)
    assert seen == [[]] and out.count() == 39 and not os.path.exists(base.removeprefix("file:"))


def test_texts_held_at_once(spark, tmp_path):
    said = str(tmp_path / "said")
    os.makedirs(said)

    class Text(str):
        live = most = 0

        def __del__(self):
            Text.live -= 1

    def extract(data):
        Text.live += 1
        if Text.live > Text.most:
            Text.most = Text.live
            open(f"{said}/{os.getpid()}-{Text.most}", "w").close()
        return Text("x" * (1 << 20))

    files = spark.range(0, 60, 1, 1).select(F.concat(F.lit("/d/"), "id", F.lit(".big")).alias("path"), F.lit(".big").alias("ext"), F.lit(b"x").alias("content"))
    ok, rejects = extract_documents(files, {".big": extract})
    assert save_table(ok).agg(F.sum(F.length("text"))).first()[0] == 60 << 20 and rejects.isEmpty()
    assert max(int(f.rpartition("-")[2]) for f in glob.glob(f"{said}/*")) <= 4


def test_python_calls_for_a_blank_of_an_odt():
    data, calls = Q.packed_odt("a b " * 1_000), 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        text = odt_text(data)
    finally:
        sys.setprofile(None)
    assert text == "a b " * 1_000 and calls < 10 * 2_000
