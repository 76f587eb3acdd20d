"""Chunking documents into overlapping pieces (K1-K7).

``chunk_documents`` returns one row per chunk ``(doc_id, chunk_index,
content)``. Two splitters:

* ``fixed``: windows of ``size`` characters stepping ``size - overlap``,
  fully native (``sequence`` + ``substring``), no Python.
* ``recursive``: separator-aware splitting (paragraph, line, sentence, word,
  character), a vectorised pandas UDF over Arrow batches because the
  buffer/merge walk is inherently sequential per document.

Documents shorter than ``size`` are one whole chunk. Split chunks are
tidied (strip, newline runs -> one space) and blanks dropped.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shroud.functions.text import has_visible_char, tidy_chunk
from shroud.session import ship_package

DEFAULT_SIZE = 1024
DEFAULT_OVERLAP = 128
# Separator order of the recursive splitter, tried first to last.
DEFAULT_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ": ", ", ", "... ", " ", "")


def validate_chunk_params(size: int, overlap: int) -> None:
    """K7: size > 0 and 0 <= overlap < size."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need 0 <= overlap < size, got size {size} and overlap {overlap}")


def fixed_windows(c: Column, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP) -> Column:
    """K2: array of windows of ``size`` characters starting every ``size - overlap``."""
    validate_chunk_params(size, overlap)
    step = size - overlap
    if overlap <= step:
        # cut once into steps, then lend each the head of the next: linear in the text,
        # where a substring per window would walk the text from its start every time
        steps = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        windows = F.zip_with(steps, F.slice(steps, F.lit(2), F.greatest(F.size(steps), F.lit(0))),
                             lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, overlap), F.lit(""))))
        count = F.greatest(F.floor((F.length(c) - overlap - 1) / step) + 1, F.lit(1)).cast("int")
        return F.when(F.length(c) == 0, F.array(F.lit(""))).otherwise(F.slice(windows, F.lit(1), count))
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - overlap, F.lit(1)), F.lit(step))
    return F.transform(starts, lambda p: F.substring(c, p, size))


# --- recursive splitter (public text-splitter behaviour, own implementation) ---


def _split_keep(text: str, sep: str) -> list[str]:
    """Split on ``sep``, keeping it at the start of the following piece; empties dropped."""
    if sep == "":
        return list(text)
    parts = text.split(sep)
    pieces = [parts[0]] + [sep + p for p in parts[1:]]
    return [p for p in pieces if p]


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    total = 0
    for piece in pieces:
        n = len(piece)
        if total + n > size and window:
            joined = "".join(window).strip()
            if joined:
                out.append(joined)
            while total > overlap or (total + n > size and total > 0):
                total -= len(window[0])
                window.pop(0)
        window.append(piece)
        total += n
    joined = "".join(window).strip()
    if joined:
        out.append(joined)
    return out


def recursive_split(text: str, size: int, overlap: int, separators=DEFAULT_SEPARATORS) -> list[str]:
    """Recursive separator split: the first separator present splits; long pieces recurse."""
    sep = separators[-1]
    rest: tuple = ()
    for i, s in enumerate(separators):
        if s == "":
            sep = s
            break
        if s in text:
            sep = s
            rest = tuple(separators[i + 1 :])
            break
    chunks: list[str] = []
    buffer: list[str] = []
    for piece in _split_keep(text, sep):
        if len(piece) < size:
            buffer.append(piece)
            continue
        if buffer:
            chunks.extend(_merge(buffer, size, overlap))
            buffer = []
        if rest:
            chunks.extend(recursive_split(piece, size, overlap, rest))
        else:
            chunks.append(piece)
    if buffer:
        chunks.extend(_merge(buffer, size, overlap))
    return chunks


def recursive_udf(size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, separators=DEFAULT_SEPARATORS):
    validate_chunk_params(size, overlap)
    seps = tuple(separators)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_texts(texts: pd.Series) -> pd.Series:
        # shorter texts are whole chunks; they come as null
        return texts.map(lambda t: recursive_split(t, size, overlap, seps) if t else [])

    return split_texts


def chunk_documents(
    docs: DataFrame,
    size: int = DEFAULT_SIZE,
    overlap: int = DEFAULT_OVERLAP,
    method: str = "recursive",
    id_col: str = "doc_id",
    text_col: str = "content",
    tidy: bool = True,
    separators=DEFAULT_SEPARATORS,
    group_size: int | None = None,
) -> DataFrame:
    """Documents -> ``(doc_id, chunk_index, content)`` rows (K1-K5).

    ``chunk_index`` is the 0-based position among the document's chunks and
    stays stable across masking rounds. Null or empty texts give no chunk.

    With ``group_size`` a column ``grp`` is added: 0 for documents with at
    most that many chunks, ``chunk_index // group_size`` for longer ones, so
    that ``(doc_id, grp)`` keys work units of bounded size even when one
    document holds a large share of all chunks.
    """
    validate_chunk_params(size, overlap)
    text = F.col(text_col)
    if method == "fixed":
        pieces = fixed_windows(text, size, overlap)
    elif method == "recursive":
        ship_package(docs.sparkSession)
        pieces = recursive_udf(size, overlap, separators)(F.when(F.length(text) >= size, text))
    else:
        raise ValueError(f"unknown chunking method: {method}")
    if tidy:
        pieces = F.filter(F.transform(pieces, tidy_chunk), lambda x: x != "")
    whole = F.array(text)
    chunks = F.when(F.length(text) < size, whole).otherwise(pieces)
    # Null or empty texts are dropped after the explode, not before: a filter
    # on the text would be pushed below the projection that computes it (for
    # instance cleaning) and evaluate that expression again. The outer explode
    # for the same reason: an inner one adds a size filter of its own.
    arrays = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(chunks, F.array()).alias("_chunks"))
    out = arrays.select("doc_id", F.size("_chunks").alias("_n"), F.posexplode_outer("_chunks").alias("chunk_index", "content"))
    out = out.where(F.col("content").isNotNull() & (F.length("content") > 0))
    if group_size:
        grp = F.when(F.col("_n") > group_size, F.floor(F.col("chunk_index") / group_size)).otherwise(0)
        out = out.withColumn("grp", grp.cast("int"))
    return out.drop("_n")


def examinable(chunks: DataFrame) -> DataFrame:
    """K6: drop whitespace-only chunks before detection."""
    return chunks.where(has_visible_char(F.col("content")))


def py_tidy(piece: str) -> str:
    """Driver-side rendering of :func:`shroud.functions.text.tidy_chunk` (tests)."""
    return re.sub(r"\n+", " ", piece.strip())
