"""N-gram Jaccard join: MinHash LSH forest with exact verification (operator 8).

Texts are cut at white space, ASCII letters lowered; a text's set holds the
hashes of its runs of five words (a shorter text is one run). Texts with the
same words in the same order are one class, and only its first document goes on.

Forest: a signature of ``trees * depth`` minima gives each class one leaf per
prefix trie. Documents meet in the trie nodes of the deepest prefix first; only
the least document of a node goes up to the next, shorter prefix, and prefixes
are shortened until the chance to miss a pair at the threshold is at most
``1 - recall``. A node of n documents gives n - 1 edges, never all its pairs.
Edges whose signatures agree far too little are dropped; connected documents
form a candidate group.

Verification is exact and covers all pairs of a candidate group: groups are
dealt into blocks of about ``block`` documents, every pair of blocks is one
task-side matrix product over the shared runs, and only counts per document and
a spanning forest of each block pair leave it.

Result: one row per document with class_id (the least doc_id of its group of
linked documents), n_links (other documents at the threshold or more, copies
included) and n_copies (other documents with the same words).

Defined results: null and empty texts, and texts of white space, link to
nothing; repeated rows are copies of each other; with a null doc_id a row takes
part, but class_id is the least id that is not null; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm import textscan as ts
from shroud.llm.common import materialize, python_workers, row_key, small_side, sorted_groups
from shroud.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.9999
#: How far below the threshold a signature's estimate may lie: over six standard deviations.
SLACK = 0.2
BLOCK = 64


def prefix_depths(threshold: float, trees: int, depth: int, recall: float) -> list[int]:
    """Prefix lengths from the deepest on, halved until a pair at the threshold is met with chance ``recall``."""
    out = [depth]
    while 1 - (1 - threshold ** out[-1]) ** trees < recall and out[-1] > 1:
        out.append(max(out[-1] // 2, 1))
    return out


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = ts.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return (r[:n] >> np.uint64(32)).astype(np.uint32), (r[n:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def word_shingles(col: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, run hashes, their bounds per row, hash of each row's word sequence)."""
    buf, off = ts.text_buffers(col)
    for lo, hi in ts.parts(off):
        raw, o = ts.lower_ascii(buf[off[lo] : off[hi]]), off[lo : hi + 1] - off[lo]
        s, e, doc = ts.tokens(raw, o)
        h = ts.token_hashes(raw, s, e)
        runs, bounds = ts.shingles(h, doc, hi - lo, width)
        cut = np.searchsorted(doc, np.arange(hi - lo + 1))
        whole = ts.span_hash(ts.prefix_hash(h), cut[:-1], cut[1:])
        yield lo, hi, runs, bounds, whole


def signatures(runs: np.ndarray, bounds: np.ndarray, n_hashes: int) -> np.ndarray:
    """Minima of ``n_hashes`` hash functions over each row's runs; rows without runs get all ones."""
    out = np.full((n_hashes, len(bounds) - 1), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        x = (runs >> np.uint64(32)).astype(np.uint32)
        for i, (flip, factor) in enumerate(zip(*_seeds(n_hashes), strict=True)):
            out[i, full] = np.minimum.reduceat((x ^ flip) * factor, bounds[:-1][full])
    return np.ascontiguousarray(out.T)


def _bytes_array(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a 2-dimensional array."""
    n, width = rows.shape[0], rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(
        pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def signature_table(docs: DataFrame, width: int, n_hashes: int) -> DataFrame:
    """(doc_id, dk, words, sig) of every row with a word; dk is the row's content key."""
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, runs, bounds, whole in word_shingles(b.column("text"), width):
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).take(pa.array(full)).cast(pa.int64()),
                     b.column("dk").slice(lo, hi - lo).take(pa.array(full)),
                     pa.array(whole[full].view(np.int64)), _bytes_array(signatures(runs, bounds, n_hashes)[full])],
                    names=["doc_id", "dk", "words", "sig"])

    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("dk"), "text")
    return keyed.mapInArrow(run, "doc_id long, dk long, words long, sig binary")


def _trie_keys(sigs: DataFrame, trees: int, depth: int, depths: list[int]) -> DataFrame:
    """One row per class and tree: dk and the key k<d> of its node at each prefix length d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, trees, depth)
            rolled = np.zeros((b.num_rows, trees), np.uint64) + np.arange(1, trees + 1, dtype=np.uint64)
            keys = {}
            for d in range(depth):
                rolled = ts.mix(rolled * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d].astype(np.uint64))
                if d + 1 in depths:
                    keys[d + 1] = rolled.view(np.int64).copy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(b.column("dk")), trees))] + [pa.array(keys[d].ravel()) for d in depths],
                names=["dk"] + [f"k{d}" for d in depths])

    return sigs.select("dk", "sig").mapInArrow(run, "dk long, " + ", ".join(f"k{d} long" for d in depths))


def candidate_edges(sigs: DataFrame, trees: int, depth: int, depths: list[int], least: float) -> DataFrame:
    """(a, b): each document with the least one of its trie node, where the signatures agree by ``least``."""
    rows = materialize(_trie_keys(sigs, trees, depth, depths), "trie-leaves")
    edges = None
    for i, d in enumerate(depths):
        rest = [f"k{x}" for x in depths[i + 1 :]]
        nodes = materialize(
            rows.groupBy(f"k{d}").agg(F.min("dk").alias("top"), F.count(F.lit(1)).alias("n"),
                                      *[F.min(r).alias(r) for r in rest]), "trie-nodes")
        shared = nodes.filter("n > 1").select(f"k{d}", "top")
        found = rows.select(f"k{d}", "dk").join(shared, f"k{d}").filter("dk <> top").select(
            F.col("dk").alias("a"), F.col("top").alias("b"))
        edges = found if edges is None else edges.union(found)
        rows = nodes.select(F.col("top").alias("dk"), *rest)
    pairs = materialize(edges.distinct(), "trie-edges")

    @F.arrow_udf("double")
    def agreement(x: pa.Array, y: pa.Array) -> pa.Array:
        n = len(x)
        left = np.frombuffer(b"".join(x.to_pylist()), np.uint32).reshape(n, trees * depth)
        right = np.frombuffer(b"".join(y.to_pylist()), np.uint32).reshape(n, trees * depth)
        return pa.array((left == right).mean(1) if n else [], pa.float64())

    a = sigs.select(F.col("dk").alias("a"), F.col("sig").alias("sig_a"))
    b = sigs.select(F.col("dk").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(a, "a").join(b, "b").filter(agreement("sig_a", "sig_b") >= least).select("a", "b")


def linked(sets: list[np.ndarray], threshold: float, across: np.ndarray | None) -> np.ndarray:
    """Boolean matrix of pairs at ``threshold`` or more; with ``across`` only pairs of different sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.float64)
    value, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size.astype(int))
    often = count[inverse] > 1
    column = (np.cumsum(count > 1) - 1)[inverse[often]]
    owner = owner[often]
    both = np.zeros((n, n))
    if len(column):
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        step = 4096
        for at in range(0, int(column[-1]) + 1, step):
            lo, hi = np.searchsorted(column, [at, at + step])
            m = np.zeros((n, step), np.float32)
            m[owner[lo:hi], column[lo:hi] - at] = 1
            both += m @ m.T
    close = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(close, False)
    if across is not None:
        close &= across[:, None] != across[None, :]
    return close


def _spanning(close: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    label = np.arange(len(close))
    while True:
        near = np.where(close, label[None, :], len(label)).min(1, initial=len(label))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(docs: DataFrame, groups: DataFrame, width: int, threshold: float, block: int) -> DataFrame:
    """(dk, links, texts, mate): per document and block pair its linked documents, linked classes, and one
    document of its component there. ``groups`` has dk, label and n_same (documents of the class)."""
    size = groups.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    n_blocks = F.ceil(F.col("m") / F.lit(block)).cast("int")
    dealt = materialize(
        groups.join(size, "label").select(
            "dk", "label", "n_same", n_blocks.alias("nb"), F.pmod(F.xxhash64("dk"), n_blocks).cast("int").alias("own")),
        "candidate-groups")
    texts = docs.select(row_key("doc_id", "text").alias("dk"), "text").join(small_side(dealt), "dk")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            others = b.drop_columns(["text"])
            for lo, hi, runs, bounds, _ in word_shingles(b.column("text"), width):
                held = [np.unique(runs[x:y]).tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                part = others.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(held, pa.binary())], names=[*part.schema.names, "runs"])

    # a repeated row gives the same key and text twice; n_same counts it already
    each = texts.mapInArrow(sets, "dk long, label long, n_same long, nb int, own int, runs binary")
    paired = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "dk", "n_same", "runs")
    ordered = paired.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "dk")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, lo, hi in sorted_groups(batches, ["label", "i", "j"]):
            dk = cols["dk"][lo:hi]
            first = np.flatnonzero(np.r_[True, dk[1:] != dk[:-1]])
            dk, own, same = dk[first], cols["own"][lo:hi][first], cols["n_same"][lo:hi][first]
            runs = cols["runs"].slice(lo, hi - lo)
            close = linked([np.frombuffer(runs[int(k)].as_buffer(), np.uint64) for k in first], threshold,
                           own if cols["i"][lo] != cols["j"][lo] else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(dk), pa.array(close @ same), pa.array(close.sum(1)), pa.array(dk[_spanning(close)])],
                names=["dk", "links", "texts", "mate"])

    return ordered.mapInArrow(verify, "dk long, links long, texts long, mate long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES,
                 depth: int = DEPTH, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, dk, class_id, n_links, n_copies, first) of every row, see the module text.
    ``first`` marks the rows of the one content that stands for the group."""
    depths = prefix_depths(threshold, trees, depth, recall)
    everyone = docs.select("doc_id", row_key("doc_id", "text").alias("dk"))
    table = materialize(signature_table(docs, width, trees * depth), "signatures")
    classes = materialize(
        table.groupBy("words").agg(F.min("dk").alias("dk"), F.count(F.lit(1)).alias("n_same")), "word-classes")
    # a content key may stand on several rows; one signature of it is enough
    sigs = materialize(
        table.select("dk", "sig").join(classes.select("dk"), "dk", "left_semi").dropDuplicates(["dk"]), "class-signatures")
    edges = candidate_edges(sigs, trees, depth, depths, threshold - SLACK)
    groups = components(edges).withColumnRenamed("node", "dk").join(classes.select("dk", "n_same"), "dk")
    checked = materialize(verified(docs, groups, width, threshold, block), "verified-links")
    links = checked.groupBy("dk").agg(F.sum("links").alias("links"))
    joined = components(checked.filter("dk <> mate").select(F.col("dk").alias("a"), F.col("mate").alias("b")))
    of_class = materialize(
        classes.join(joined.withColumnRenamed("node", "dk"), "dk", "left").join(links, "dk", "left")
        .select("words", "n_same", F.coalesce("label", "dk").alias("label"), F.coalesce("links", F.lit(0)).alias("links")),
        "class-links")
    each = materialize(
        table.select("doc_id", "dk", "words").join(of_class, "words")
        .select("doc_id", "dk", "label", (F.col("links") + F.col("n_same") - 1).alias("n_links"),
                (F.col("n_same") - 1).alias("n_copies")), "document-links")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("o"), F.col("dk").alias("dk"))
    heads = materialize(
        each.filter("n_links > 0").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.min(order).alias("head")),
        "group-heads")
    alone = everyone.join(table.select("dk"), "dk", "left_anti").select(
        "doc_id", "dk", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        F.lit(0).cast("long").alias("n_copies"), F.lit(True).alias("first"))
    found = each.join(heads, "label", "left").select(
        "doc_id", "dk", F.when(F.col("n_links") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        "n_links", "n_copies",
        ((F.col("n_links") == 0) | (F.col("head.dk") == F.col("dk"))).alias("first"))
    return found.union(alone)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of linked documents: the one with the least (doc_id, content)."""
    keyed = docs.withColumn("nd_key", row_key("doc_id", "text"))
    table = materialize(jaccard_join(docs, **options), "near-duplicates")
    gone = table.filter("not first").select(F.col("dk").alias("nd_key")).distinct()
    several = table.filter("first and n_copies > 0").groupBy(F.col("dk").alias("nd_key")).count().filter("count > 1")
    gone, several = materialize(gone, "gone"), materialize(several.select("nd_key"), "repeated-rows")
    kept = keyed.join(small_side(gone), "nd_key", "left_anti")
    once = kept.join(small_side(several), "nd_key", "left_anti")
    repeated = kept.join(small_side(several), "nd_key", "left_semi").dropDuplicates(["nd_key"])
    return once.union(repeated).select(*docs.columns)
