"""Fill-in-the-middle transformation of whole texts (operator 12).

A text of n units (code points, or the matches of a pattern from left to right) is cut after a and b units, a <= b,
into prefix, middle and suffix, and rearranged around sentinels: ``psm`` is prefix, suffix, middle, ``spm`` suffix,
prefix, middle. Where the cuts fall, which form a text takes and which texts stay plain follows from a sha256 of the
seed and the document's id alone, so a document has one form however the table is partitioned.

The text stays in its UTF-8 bytes. A Fenwick tree over fixed blocks of ``BLOCK`` bytes holds how many units and how
many code points begin in each; a cut is found by a binary-lifting descent to the block in which its unit begins, and
then within that block alone. ``restore`` undoes the form in SQL expressions; it is exact because a text that holds a
sentinel stays plain, and sentinels that could overlap with each other or themselves are refused.

Defined results: a null text is empty and so plain; a null id has the seed alone in its hash; equal ids draw alike;
an empty table gives no rows; texts of any length are transformed whole; all columns are kept, but the text is replaced
by its transformed form, and columns named as the added ones (``fim_form``, ``fim_units``, ``fim_prefix_chars``,
``fim_middle_chars``) are replaced. The counts of code points are null where the text is plain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.llm.common import python_workers
from shroud.llm.textscan import text_buffers

#: Bytes of a block of the tree.
BLOCK = 1_024
#: Sentinels before prefix, suffix and middle (fixed values).
SENTINELS = ("<P>", "<S>", "<M>")
ADDED = {"fim_form": "string", "fim_units": "long", "fim_prefix_chars": "long", "fim_middle_chars": "long"}


class BlockTree:
    """Fenwick tree over blocks of a text: how many units and code points begin in each."""

    def __init__(self, raw: np.ndarray, units: np.ndarray, points: np.ndarray, block: int = BLOCK):
        """``units`` and ``points`` mark the bytes of ``raw`` at which a unit or a code point begins."""
        self.units, self.points, self.block, self.size = units, points, block, len(raw)
        at = np.arange(0, len(raw), block)
        i = np.arange(len(at) + 1)
        low = i & -i
        self.nodes = []  # node i sums the blocks from i - lowbit(i) to i - 1
        for marks in (units, points):
            upto = np.concatenate([[0], np.cumsum(np.add.reduceat(marks, at, dtype=np.int64))]) if len(at) else np.zeros(1, np.int64)
            self.nodes.append((upto - upto[i - low]).tolist())
        self.blocks = len(at)
        self.n_units, self.n_points = int(units.sum()), int(points.sum())

    def cut(self, after: int) -> tuple[int, int]:
        """(bytes, code points) before the cut that has ``after`` units before it."""
        if after >= self.n_units:
            return self.size, self.n_points
        units, points = self.nodes
        at, left, seen = 0, after, 0
        step = 1 << self.blocks.bit_length()
        while step := step >> 1:
            if at + step <= self.blocks and units[at + step] <= left:
                at += step
                left -= units[at]
                seen += points[at]
        lo = at * self.block
        inside = int(np.flatnonzero(self.units[lo : lo + self.block])[left])
        return lo + inside, seen + int(self.points[lo : lo + inside].sum())


def unit_starts(raw: np.ndarray, points: np.ndarray, pattern: re.Pattern | None) -> np.ndarray:
    """Marks of the units: code points, or the pattern's non-empty matches and every code point between them."""
    if pattern is None:
        return points
    text = raw.tobytes().decode("utf-8")
    starts = np.ones(len(text), bool)
    for m in pattern.finditer(text):
        starts[m.start() + 1 : m.end()] = False
    marks = np.zeros(len(raw), bool)
    marks[np.flatnonzero(points)[starts]] = True
    return marks


def draws(seed: str, doc_id: str | None) -> tuple[int, ...]:
    """The first four 8-digit groups of the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def arrange(raw: np.ndarray, draw: tuple[int, ...], pattern: re.Pattern | None = None, fim_percent: int = 90,
            spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS, block: int = BLOCK):
    """(output, form, units, code points of the prefix, of the middle) of one text."""
    p, s, m = (x.encode() for x in sentinels)
    text = raw.tobytes()
    points = (raw & 0xC0) != 0x80
    units = unit_starts(raw, points, pattern)
    n = int(units.sum())
    if not text or draw[2] % 100 >= fim_percent or any(x in text for x in (p, s, m)):
        return text, "plain", n, None, None
    tree = BlockTree(raw, units, points, block)
    (a, a_points), (b, b_points) = (tree.cut(x) for x in sorted((draw[0] % (n + 1), draw[1] % (n + 1))))
    if draw[3] % 100 < spm_percent:
        form, out = "spm", (s, text[b:], p, text[:a], m, text[a:b])
    else:
        form, out = "psm", (p, text[:a], s, text[b:], m, text[a:b])
    return b"".join(out), form, n, a_points, b_points - a_points


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or i != j and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError("sentinels must not be empty, hold each other or overlap")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str | None = None,
                   fim_percent: int = 90, spm_percent: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with every text in its form, and the columns of ``ADDED``. ``unit`` is a regular expression whose
    matches are units (None: code points); cuts never fall inside one."""
    check_sentinels(sentinels)
    python_workers(docs.sparkSession)
    pattern = re.compile(unit) if unit else None
    kept = [f for f in docs.schema.fields if f.name not in ADDED and f.name != text_col]
    names = [*[f.name for f in kept], text_col, *ADDED]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)]).add("fim_text", "string")
    for name, kind in ADDED.items():
        schema.add(name, kind)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_buffers(b.column(n))
            rows = [arrange(raw[lo:hi], draws(seed, i), pattern, fim_percent, spm_percent, sentinels)
                    for lo, hi, i in zip(off[:-1], off[1:], b.column(n + 1).to_pylist(), strict=True)]
            text, form, units, prefix, middle = zip(*rows, strict=True) if rows else [()] * 5
            added = [pa.array(text, pa.binary()).cast(pa.string()), pa.array(form, pa.string())]
            added += [pa.array(x, pa.int64()) for x in (units, prefix, middle)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *added], names=schema.names)

    column = lambda name: F.col("`" + name.replace("`", "``") + "`")
    source = docs.select(*[column(f.name).alias(f"c{i}") for i, f in enumerate(kept)],
                         column(text_col).cast("string").alias("fim_source"), column(id_col).cast("string").alias("fim_id"))
    return source.mapInArrow(run, schema).toDF(*names)


def restore(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that was transformed."""
    check_sentinels(sentinels)
    p, s, m = sentinels
    at = lambda x: F.instr(text, x)
    piece = lambda mark, until: F.substring(text, at(mark) + len(mark), until - at(mark) - len(mark))
    end = F.length(text) + 1
    psm = F.concat(piece(p, at(s)), piece(m, end), piece(s, at(m)))
    spm = F.concat(piece(p, at(m)), piece(m, end), piece(s, at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)
