"""Sum-of-squares online packing of tokenized documents into fixed windows (operator 2).

Every task packs the documents of its own scan split as they come. A document
is cut only where it must be: whole windows first, then one rest shorter than a
window. The rest goes to the fill level that leaves the sum of squares of the
numbers of windows per level smallest; the level array and one stack of open
windows per level are all the state. When the split ends, the windows still
open are run together and cut into full windows, and what remains is laid out
in sequences whose lengths are powers of two, so nothing is padded.

Memory is one batch plus the open windows; there is no shuffle. Sequence ids
are the partition number in the high bits and a running number below, so they
are distinct without coordination.

Defined results: a null text is an empty text (one piece holding the end id); a
very long text gives many pieces; repeated rows are packed as often as they
occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shroud.llm.common import python_workers
from shroud.llm.tokenize import tokenizer

WINDOW = 2048
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


class SumOfSquares:
    """Open windows by fill level; ``place`` returns the window that a piece fills."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1)
        self.taken = np.full(window + 1, -np.inf)  # as count, for levels that have a window
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def _add(self, level: int, change: int) -> None:
        self.count[level] += change
        self.taken[level] = self.count[level] or -np.inf

    def place(self, piece: tuple, size: int) -> list | None:
        """Add the piece at the best level; the pieces of the window if that fills it.

        Half the change of the sum of squares: count[h + size] - count[h] + 1 for
        an open level h, 0.5 - count[h] where the piece fills it up, and
        count[size] + 0.5 for a new window.
        """
        top = self.window - size
        level, best = 0, self.count[size] + 0.5 if top else 0.5
        if top > 1:
            gain = self.taken[1:top] - self.count[size + 1 : self.window]
            k = int(gain.argmax())
            if 1 - gain[k] <= best:
                level, best = k + 1, 1 - gain[k]
        if top and 0.5 - self.taken[top] <= best:
            level = top
        held = []
        if level:
            held = self.open[level].pop()
            self._add(level, -1)
        held.append(piece)
        if level + size == self.window:
            return held
        self._add(level + size, 1)
        self.open[level + size].append(held)
        return None

    def rest(self) -> Iterator[list]:
        for level in range(self.window, 0, -1):
            yield from self.open[level]


def lay_out(pieces: Iterator[tuple], window: int) -> Iterator[list[tuple]]:
    """Cut a stream of (doc, start, ids, total) into full windows, the remainder into powers of two."""
    held, room = [], window
    for doc, start, ids, total in pieces:
        while len(ids):
            take = min(room, len(ids))
            held.append((doc, start, ids[:take], total))
            start, ids, room = start + take, ids[take:], room - take
            if not room:
                yield held
                held, room = [], window
    size = window
    while held:
        left = sum(len(p[2]) for p in held)
        while size > left:
            size //= 2
        first, rest, room = [], [], size
        for doc, start, ids, total in held:
            take = min(room, len(ids))
            if take:
                first.append((doc, start, ids[:take], total))
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], total))
            room -= take
        yield first
        held = rest


def _rows(sequences: list[list[tuple]], first_id: int) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(8)]
    for k, pieces in enumerate(sequences):
        offset, size = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, total in pieces:
            crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
            for col, v in zip(out, (doc, start, len(ids), crc, total, first_id + k, offset, size), strict=True):
                col.append(v)
            offset += len(ids)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), see the module text; ``window`` is a power of two."""
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    python_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(tokenizer_path)
        next_id = TaskContext.get().partitionId() << 40
        levels = SumOfSquares(window)
        end = np.array([end_id], np.uint32)
        done: list[list[tuple]] = []
        for b in batches:
            ids_col = b.column("doc_id").to_pylist()
            texts = [t or "" for t in b.column("text").to_pylist()]
            for doc, ids in zip(ids_col, tok.encode(texts), strict=True):
                ids = np.concatenate([ids, end])
                total = len(ids)
                whole = total - total % window
                done += [[(doc, at, ids[at : at + window], total)] for at in range(0, whole, window)]
                if whole < total and (full := levels.place((doc, whole, ids[whole:].copy(), total), total - whole)):
                    done.append(full)
                if len(done) >= 4096:
                    yield _rows(done, next_id)
                    next_id, done = next_id + len(done), []
        done += lay_out((p for held in levels.rest() for p in held), window)
        for at in range(0, len(done), 4096):
            yield _rows(done[at : at + 4096], next_id + at)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
