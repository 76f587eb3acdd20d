"""Line dedup by pairwise alignment (operator 1).

Documents are ordered by (doc_id, content key). Every line occurrence (line
hash, which occurrence of it in its document) finds the earliest document that
holds it; so a later document meets each earlier one it shares lines with
through at most a few rows per line, whatever the size of a group of copies.
A line under ``min_bytes`` also stands for the shortest run of lines from it on
that has ``min_bytes``, and the run finds the earliest document that holds all
of it, so that a block of short lines stays whole where each of them has a
holder of its own. Lines and runs that a document repeats are numbered from both ends, and the earliest
holder gives its first and its last one, so that a line meets its like whether
it is repeated in the earlier document, in the later one or in both. Per pair
of documents the shared lines and runs are aligned by patience: lines that occur once in
both, runs, and repeated lines of ``min_bytes`` or more give the longest increasing
chain of anchors, stretches between anchors that are equal byte by byte (by
their running hashes) join them into one block, and blocks grow over equal
neighbouring lines that are short and repeated. Blocks of ``min_bytes`` or more
are deleted from the later document. An alignment is one to one: of a passage
that the later document holds more often than the earlier one, the surplus
stays. It also keeps the order: of two passages that the documents hold in
opposite orders the one off the longest chain stays.

Shuffles: line rows (no text) by line for the earliest holder and for the join
(hot lines are pre-aggregated, and the join is open to skew splitting), shared
lines by later document, and the texts once, to meet their deletions.

Defined results: a null text stays null; an empty text stays empty; rows equal
in doc_id and text are one document and keep equal texts; a null doc_id comes
after all others; a document whose lines are all deleted has the empty text;
an empty table gives no rows; other columns are kept as they are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm import textscan as ts
from shroud.llm.common import materialize, python_workers, row_key, set_aside, sorted_groups

LINE_SCHEMA = ("dd_ord long, dd_key long, pos long, last long, occ long, cnt long, h long, "
               "a long, b long, pa long, pb long")


def _line_rows(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per non-empty line, and one per line under ``min_bytes`` for the shortest run of lines from
    it on that has ``min_bytes``: its first and last position, occurrence number and count in the document,
    hash, byte range, and the document's running byte hash at both ends. A line or run that the
    document repeats has a second row, with its occurrence number from the end (-1 is the last)."""
    names = [c.split()[0] for c in LINE_SCHEMA.split(", ")]
    for batch in batches:
        order, key = np.asarray(batch.column("dd_ord")), np.asarray(batch.column("dd_key"))
        buf, off = ts.text_buffers(batch.column("text"))
        for lo, hi in ts.parts(off):
            raw, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            s, e, doc = ts.tokens(raw, o, b"\n")
            if not len(s):
                continue
            prefix = ts.prefix_hash(raw.astype(np.uint64) + np.uint64(1))
            breaks = np.concatenate([[0], np.cumsum(raw == 10)])
            final = np.searchsorted(e, s + min_bytes)
            run = np.flatnonzero((final > np.arange(len(s))) & (final < len(s)))
            run = run[doc[final[run]] == doc[run]]
            last = np.concatenate([breaks[s], breaks[s[final[run]]]])
            s, e, doc = (np.concatenate([x, y]) for x, y in ((s, s[run]), (e, e[final[run]]), (doc, doc[run])))
            h = ts.span_hash(prefix, s, e)
            begin = o[doc]
            by = np.lexsort((s, h, doc))  # occurrences of one line or run in one document stand together
            fresh = np.ones(len(by), bool)
            fresh[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
            group = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            occ, cnt = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
            occ[by] = np.arange(len(by)) - first[group]
            cnt[by] = np.diff(np.append(first, len(by)))[group]
            cols = [order[lo:hi][doc], key[lo:hi][doc], breaks[s] - breaks[begin], last - breaks[begin], occ, cnt,
                    h.view(np.int64), s - begin, e - begin, ts.between(prefix, begin, s, begin).view(np.int64),
                    ts.between(prefix, begin, e, begin).view(np.int64)]
            again = np.flatnonzero(cnt > 1)
            cols = [np.concatenate([c, (occ - cnt if c is occ else c)[again]]) for c in cols]
            for at in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000], pa.int64()) for c in cols], names=names)


def longest_chain(values: list) -> list[int]:
    """Indices of a longest strictly increasing subsequence (patience sorting)."""
    tops: list = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _same_between(x: dict, i: int, j: int) -> bool:
    """Whether the bytes between shared lines i and j are equal in both documents."""
    b, fb = int(x["b"][i]), int(x["f_b"][i])
    if int(x["a"][j]) - b != int(x["f_a"][j]) - fb:
        return False
    mine = ts.shifted_difference(int(x["pa"][j]), int(x["pb"][i]), b)
    return mine == ts.shifted_difference(int(x["f_pa"][j]), int(x["f_pb"][i]), fb)


def common_blocks(x: dict, min_bytes: int) -> list[tuple[int, int]]:
    """[first, last] line numbers, in the later document, of the blocks that align with the earlier.

    ``x`` holds the shared lines and runs of one pair, sorted by first and last position in the later
    document and, where one may align with several of the earlier, from the last of them to the first.
    """
    pos, stop_at, f_pos = x["pos"].tolist(), x["last"].tolist(), x["f_pos"].tolist()
    anchors = np.flatnonzero((x["cnt"] == 1) & (x["f_cnt"] == 1) | (x["b"] - x["a"] >= min_bytes)).tolist()
    # a line and the run from it on may both stand in the chain
    chain = [anchors[k] for k in longest_chain([(f_pos[i], stop_at[i] - pos[i]) for i in anchors])]
    where = {(pos[i], f_pos[i]): i for i in range(len(pos)) if pos[i] == stop_at[i]}

    def grow(i: int, step: int, stop: int) -> int:
        edge = (stop_at[i] if step > 0 else pos[i]) + step
        while (k := where.get((edge, edge + f_pos[i] - pos[i]))) is not None and edge != stop:
            i, edge = k, edge + step
        return i

    out, last = [], -1
    at = 0
    while at < len(chain):
        begin = grow(chain[at], -1, last)
        end = chain[at]
        while at + 1 < len(chain) and (pos[chain[at + 1]] <= stop_at[end] or _same_between(x, end, chain[at + 1])):
            at += 1
            end = max(end, chain[at], key=stop_at.__getitem__)
        at += 1
        end = grow(end, 1, pos[chain[at]] if at < len(chain) else -1)
        last = stop_at[end]
        if x["b"][end] - x["a"][begin] >= min_bytes:
            out.append((pos[begin], last))
    return out


def deletions(docs: DataFrame, min_bytes: int) -> DataFrame:
    """(dd_key, first, last): blocks of lines to delete from the document with this key.
    ``docs`` has dd_ord, dd_key and text."""
    python_workers(docs.sparkSession)
    lines = docs.select("dd_ord", "dd_key", "text").mapInArrow(
        lambda batches: _line_rows(batches, min_bytes), LINE_SCHEMA)
    held = ["dd_ord", "dd_key", "pos", "cnt", "a", "b", "pa", "pb"]
    # written, so that the join below deals both sides itself and hot lines can be split
    first = materialize(
        lines.groupBy("h", "occ").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*held)).alias("f"))
        .filter("n > 1 or occ < 0")
        # first and last occurrences meet each other too, as a document without repeats has no rows from the end
        .select("h", F.explode(F.expr("case when occ in (0, -1) then array(0L, -1L) else array(occ) end")).alias("occ"),
                *[F.col(f"f.{c}").alias(f"f_{c}") for c in held]),
        "earliest-lines",
    )
    shared = lines.join(first, ["h", "occ"]).filter(
        "f_dd_ord < dd_ord or f_dd_ord = dd_ord and f_dd_key < dd_key").drop("h", "occ", "dd_ord", "f_dd_ord")
    ordered = shared.repartition("dd_key").sortWithinPartitions("dd_key", "f_dd_key", "pos", "last", F.desc("f_pos"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for cols, lo, hi in sorted_groups(batches, ["dd_key", "f_dd_key"]):
            pair = {n: c[lo:hi] for n, c in cols.items()}
            keep = np.ones(hi - lo, bool)  # rows equal in id and text give equal rows, as do both numberings
            keep[1:] = np.any([pair[n][1:] != pair[n][:-1] for n in ("pos", "last", "f_pos")], axis=0)
            key = int(pair["dd_key"][0])
            out += [(key, s, e) for s, e in common_blocks({n: c[keep] for n, c in pair.items()}, min_bytes)]
            if len(out) >= 10_000:
                yield _block_batch(out)
                out = []
        yield _block_batch(out)

    return ordered.mapInArrow(blocks, "dd_key long, first long, last long")


def _block_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["dd_key", "first", "last"])


def dedup_lines(docs: DataFrame, min_bytes: int = 40) -> DataFrame:
    """``docs`` with the text cut as described above, plus n_lines and n_deleted."""
    docs, back = set_aside(docs, lambda c: c.startswith("dd_") or "." in c)
    keyed = docs.withColumn("dd_key", row_key("doc_id", "text")).withColumn(
        "dd_ord", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    blocks = deletions(keyed, min_bytes).distinct().groupBy("dd_key").agg(
        F.collect_list(F.struct("first", "last")).alias("dd_blocks"))
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists(F.col("dd_blocks"), lambda r: (r["first"] <= i) & (i <= r["last"])))
    joined = keyed.join(blocks.hint("shuffle_hash"), "dd_key", "left")
    cut = F.col("dd_blocks").isNotNull()
    out = joined.select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_deleted")],
        F.when(cut, F.concat_ws("\n", kept)).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(cut, F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("n_deleted"),
    )
    return back(out)
