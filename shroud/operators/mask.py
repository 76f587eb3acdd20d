"""Finding and masking known items in chunks (M1-M9).

Items of a document apply to that document's chunks only. How a chunk meets
its document's items depends on how many distinct items the document has:

* at most ``max_inline_items`` (the usual case): the document's item list is
  collected (size bounded by that check) and joined to its chunks on
  ``doc_id``; matching runs in-row with native higher-order functions.
* more than that: an exact prefix index join. An item's key is its first
  1, 2, 4, ... or ``q`` characters, the longest such prefix it has; every
  position of those documents' chunks emits its prefixes of the lengths that
  occur (at most seven); an equi-join on ``(doc_id, prefix)`` gives candidate
  positions, verified against the chunk text. A key covers at least half of
  an item, so items that begin alike (phone numbers, addresses of one network)
  do not all meet at every position.

A chunk is known by ``(doc_id, chunk_index)`` and a hash of its text, so
several texts under one id keep apart on both paths.

Semantics: positions are found in the fully folded chunk ("NFKD, combining marks
dropped") and mapped back to the original characters, so a ligature, a fraction
sign, a Hangul syllable or a decomposed accent neither hides an item nor shifts
what follows it; a range goes from the character that gives the match's first
folded character to the one that gives its last. Every occurrence counts,
overlapping ones too; overlapping or touching ranges merge; each range becomes as
many ``*`` as it is long. Items that fold to '' are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.functions.arrays import once, running
from shroud.functions.fold import fold, full_fold, match_key, origins, special_folds

DEFAULT_MAX_INLINE_ITEMS = 512
DEFAULT_Q = 64

RANGE_TYPE = "array<struct<s:int,e:int>>"


# --- per-document item lists ---------------------------------------------------


def _folded(df: DataFrame, text: str, case_insensitive: bool, key: str, origin: str | None = None) -> DataFrame:
    """``df`` with what masking compares as ``key``: the folded text, lower-cased too when masking ignores case (Q9
    option); ``origin``: where its characters come from."""
    out = df.withColumn("_folds", special_folds(text))
    folded = full_fold(F.col(text), F.col("_folds"))
    cols = {key: F.lower(folded) if case_insensitive else folded}
    if origin:
        cols[origin] = origins("_folds")
    return out.withColumns(cols).drop("_folds")


def doc_items(detections: DataFrame) -> DataFrame:
    """Distinct item texts per document with their folded form: ``doc_id, text, fi, li``."""
    return (
        detections.where(F.col("text").isNotNull())
        .select("doc_id", "text")
        .distinct()
        .select("doc_id", "text", fold(F.col("text")).alias("fi"), F.length("text").alias("li"))
        .where(F.length("fi") > 0)
    )


def split_by_item_count(items: DataFrame, max_inline_items: int, key: str = "fi"
                        ) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(inline item arrays per doc, items of heavy docs, heavy doc ids).

    Arrays are built only for documents whose distinct item count passed the
    bound, so no collected list is larger than ``max_inline_items``. Whether
    any heavy document exists is checked first (a count over the per-document
    counts, a small table); without one, the plan has no heavy branch.
    """
    counts = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"))
    heavy_ids = counts.where(F.col("n_items") > max_inline_items).select("doc_id")
    fields = [c for c in items.columns if c != "doc_id"]
    if heavy_ids.limit(1).count() == 0:
        arrays = items.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("items"))
        return arrays, None, None
    arrays = (
        items.join(heavy_ids, "doc_id", "left_anti")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct(*fields)).alias("items"))
    )
    heavy_items = items.join(heavy_ids, "doc_id", "left_semi")
    return arrays, heavy_items, heavy_ids


# --- in-row matching (bounded item lists) -----------------------------------------


def occurrences(text: str, item: str) -> str:
    """0-based positions of every occurrence of ``item`` in ``text``, overlapping ones too.

    The text is cut in front of every occurrence (a look-ahead, so cuts may lie inside an occurrence); the running sum
    of the pieces' lengths gives the positions. Linear in the text, where a substring per position walks it each time.
    """
    quoted = rf"concat(r'(?=\Q', replace({item}, r'\E', r'\E\\E\Q'), r'\E)')"
    ends = running(f"transform(split({text}, {quoted}, -1), x -> length(x))", "a + b")
    inner = "slice(ends, 1, size(ends) - 1)"  # the last piece ends where the text does
    at = f"if(startswith({text}, {item}), concat(array(0), {inner}), {inner})"
    return f"if(instr({text}, {item}) > 0, {once(ends, 'ends', at)}, cast(array() as array<int>))"


def match_ranges_col(ft: str, origin: str, items: str) -> Column:
    """M5: 0-based [s, e) ranges of every occurrence of every item in a chunk.

    ``ft`` is a column that holds the folded chunk, computed beforehand; ``origin`` holds the original position of
    each of its characters (null: its own).
    """
    back = lambda p: f"coalesce(get({origin}, {p}), {p})"
    found = f"struct({back('p')} as s, {back('p + length(it.fi) - 1')} + 1 as e)"
    per_item = f"transform({occurrences(ft, 'it.fi')}, p -> {found})"
    return F.expr(f"cast(flatten(transform(coalesce({items}, array()), it -> {per_item})) as {RANGE_TYPE})")


def merge_ranges(ranges: str) -> str:
    """M6: overlapping or touching ranges merged: sorted, swept with the running maximum of their ends. A range that
    begins beyond all ends before it opens an island; an island ends at the maximum before the next one opens."""
    opens = "filter(sequence(0, size(o) - 1), i -> i = 0 or get(o, i).s > get(top, i - 1))"
    island = "struct(get(o, i).s as s, get(top, coalesce(get(idx, j + 1), size(o)) - 1) as e)"
    islands = once(opens, "idx", f"transform(idx, (i, j) -> {island})")
    swept = once(f"array_sort({ranges})", "o", once(running("transform(o, r -> r.e)", "greatest(a, b)"), "top", islands))
    return f"cast(if(size({ranges}) <= 1, {ranges}, {swept}) as {RANGE_TYPE})"


def merge_ranges_col(ranges: str) -> Column:
    return F.expr(merge_ranges(ranges))


def apply_ranges_col(content: str, ranges: str) -> Column:
    """M7: replace every merged range by as many '*' as it is long."""
    between = lambda a, b: f"array_join(slice(chars, {a} + 1, {b} - {a}), '')"
    before = lambda i: f"coalesce(get(merged, {i} - 1).e, 0)"
    part = f"concat({between(before('i'), 'r.s')}, repeat('*', r.e - r.s))"
    starred = f"concat(array_join(transform(merged, (r, i) -> {part}), ''), {between(before('size(merged)'), 'size(chars)')})"
    masked = once(merge_ranges(ranges), "merged", once(f"split({content}, '')", "chars", starred))
    return F.expr(f"if(size({ranges}) > 0, {masked}, {content})")


def contains_any_col(tk: Column, keys: Column) -> Column:
    """M2 on precomputed keys: does any (non-empty) item key occur in the text key ``tk``?

    ``tk`` should be a column computed beforehand (``match_key(content)``).
    """
    return F.exists(F.coalesce(keys, F.array()), lambda k: (F.length(k) > 0) & (F.instr(tk, k) > 0))


def contains_any(text: Column, items: Column, case_insensitive: bool = True, normalize: bool = True) -> Column:
    """M2: ``pii_exist_in_text``: false on empty text or list; folded and case-folded by default."""
    tk = match_key(text, case_insensitive, normalize)
    found = F.exists(items, lambda i: (F.length(match_key(i, case_insensitive, normalize)) > 0)
                     & (F.instr(tk, match_key(i, case_insensitive, normalize)) > 0))
    return F.coalesce((F.length(text) > 0) & (F.size(items) > 0) & found, F.lit(False))


# --- q-gram index join (documents with many items) -------------------------------


_CHUNK = ["doc_id", "chunk_index", "_row"]


def _with_row(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("_row", F.xxhash64("content"))


def _key_length(item: Column, q: int) -> Column:
    """The largest power of two that is at most the item's length and ``q``."""
    n = F.least(F.length(item), F.lit(q))
    return F.greatest(*[F.when(n >= 1 << i, 1 << i) for i in range(q.bit_length())], F.lit(1))


def _prefix_rows(chunks: DataFrame, key_col: str, items: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per (chunk position, prefix length): the chunk's identity, ``p`` and ``key``.

    Only positions with a character that some item (``doc_id, _ik``) of the document begins with are taken: no other
    can meet one. The characters are cut once, so a position that isn't taken costs no walk through the text. The
    prefixes are built in-row and exploded once, so a position row holds only its short prefix, not the chunk text.
    """
    firsts = items.groupBy("doc_id").agg(F.array_join(F.collect_set(F.substring("_ik", 1, 1)), "").alias("_firsts"))
    k = F.col(key_col)
    n = F.length(k)
    lens = F.array(*[F.lit(x) for x in lengths])

    def at(p):
        fitting = F.filter(lens, lambda l: p + l - 1 <= n)
        return F.transform(fitting, lambda l: F.struct(p.alias("p"), F.substring(k, p, l).alias("key")))

    chars = F.transform(F.split(k, ""), lambda c, i: F.when(F.instr(F.col("_firsts"), c) > 0, i + 1))
    entries = F.flatten(F.transform(F.filter(chars, lambda p: p.isNotNull()), at))
    return chunks.join(firsts, "doc_id").select(*_CHUNK, F.explode(entries).alias("e")).select(*_CHUNK, "e.p", "e.key")


def qgram_candidates(chunks: DataFrame, chunk_key: str, items: DataFrame, item_key: str, q: int = DEFAULT_Q,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Exact substring hits of item keys in chunk keys, via an equi-join on prefixes.

    ``chunks`` carry ``_row``. Returns the chunk's identity, ``p`` (1-based), ``keep``
    and the item columns, only for verified hits. Chunk text is not carried through
    the explode; the verification joins the candidates back to the chunks.
    """
    item_side = items.withColumn("_ik", F.col(item_key)).withColumn("_kl", _key_length(F.col("_ik"), q))
    # at most seven lengths, so collecting them is bounded
    lengths = sorted(r["_kl"] for r in item_side.select("_kl").distinct().collect())
    prefixes = _prefix_rows(chunks, chunk_key, item_side, lengths or [1])
    item_side = item_side.withColumn("key", F.expr("substring(_ik, 1, _kl)")).drop("_kl")
    cands = prefixes.join(item_side, ["doc_id", "key"]).drop("key")
    texts = chunks.select(*_CHUNK, F.col(chunk_key).alias("_ck"), *keep)
    verified = cands.join(texts, _CHUNK).where(
        F.substring(F.col("_ck"), F.col("p"), F.length("_ik")) == F.col("_ik")
    )
    return verified.drop("_ik", "_ck")


# --- chunk-level operators -----------------------------------------------------------


def _part(chunks: DataFrame) -> list[str]:
    """Work-unit key of a chunk table: ``doc_id``, or ``(doc_id, grp)`` when long documents are split."""
    return ["doc_id", "grp"] if "grp" in chunks.columns else ["doc_id"]


def _per_part(chunks: DataFrame, by_doc_table: DataFrame) -> DataFrame:
    """Re-key a per-document table to the chunk table's work units (one copy per chunk group).

    The group list is a distinct over the chunk table's own key, so it needs
    no exchange of the text; the per-document table is small.
    """
    if _part(chunks) == ["doc_id"]:
        return by_doc_table
    groups = chunks.select("doc_id", "grp").distinct()
    return groups.join(by_doc_table, "doc_id")


def _keyed_chunks(chunks: DataFrame, arrays: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks of documents that have items, with the columns that ``keyed`` adds (e.g. the folded text).

    A key is computed below the join with the item arrays on purpose: a
    filter or projection above the join can then only refer to the column,
    so the optimizer cannot substitute the expression back into a per-position
    lambda (which would fold the chunk once per position).
    """
    part = _part(chunks)
    arrays = _per_part(chunks, arrays)
    ids = arrays.select(*part)
    return keyed(chunks.join(ids, part, "left_semi")).join(arrays, part)


def ranges_per_chunk(chunks: DataFrame, items: DataFrame, max_inline_items: int = DEFAULT_MAX_INLINE_ITEMS,
                     q: int = DEFAULT_Q, case_insensitive: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """M3+M5: ``doc_id, chunk_index, content, ranges`` (and ``keep``) for chunks of documents with items.

    ``items`` holds ``doc_id, text`` (e.g. :func:`doc_items`); the comparison
    keys are derived here so they always match ``case_insensitive``.
    """
    # a text folds to '' either way or not at all: the short test spares the optimizer a second copy of the long one
    items = _folded(items.where(F.length(fold(F.col("text"))) > 0), "text", case_insensitive, "fi").select("doc_id", "fi")
    arrays, heavy_items, heavy_ids = split_by_item_count(items, max_inline_items)
    part = _part(chunks)
    folded = lambda df: _folded(df, "content", case_insensitive, "_ft", "_origin")
    light = _keyed_chunks(chunks, arrays, folded).select(
        *part, "chunk_index", "content", *keep,
        match_ranges_col("_ft", "_origin", "items").alias("ranges"),
    )
    if heavy_ids is None:
        return light
    heavy_chunks = folded(_with_row(chunks.join(_per_part(chunks, heavy_ids), part, "left_semi")))
    hits = qgram_candidates(heavy_chunks, "_ft", heavy_items, "fi", q, keep=["_origin"])
    back = lambda p: F.coalesce(F.get("_origin", p), p)
    heavy_ranges = hits.groupBy(*_CHUNK).agg(F.collect_set(F.struct(
        back(F.col("p") - 1).alias("s"), (back(F.col("p") + F.length("fi") - 2) + 1).alias("e"))).alias("ranges"))
    heavy = heavy_chunks.drop("_ft", "_origin").join(heavy_ranges, _CHUNK, "left").select(
        *part, "chunk_index", "content", *keep, F.coalesce(F.col("ranges"), F.array().cast(RANGE_TYPE)).alias("ranges")
    )
    return light.unionByName(heavy)


def chunks_with_items(chunks: DataFrame, items: DataFrame, max_inline_items: int = DEFAULT_MAX_INLINE_ITEMS,
                      q: int = DEFAULT_Q, case_insensitive: bool = True, normalize: bool = True) -> DataFrame:
    """M2-M4: chunks holding at least one item of their own document (existence test)."""
    keyed = items.select("doc_id", match_key(F.col("text"), case_insensitive, normalize).alias("k")) \
        .where(F.length("k") > 0).distinct()
    arrays, heavy_items, heavy_ids = split_by_item_count(keyed, max_inline_items, key="k")
    light = (
        _keyed_chunks(chunks, arrays, lambda df: df.withColumn("_tk", match_key(F.col("content"), case_insensitive, normalize)))
        .where((F.length("content") > 0) & contains_any_col(F.col("_tk"), F.col("items")["k"]))
        .drop("items", "_tk")
    )
    if heavy_ids is None:
        return light
    heavy_chunks = _with_row(chunks.join(_per_part(chunks, heavy_ids), _part(chunks), "left_semi").where(F.length("content") > 0)) \
        .withColumn("_tk", match_key(F.col("content"), case_insensitive, normalize))
    hit_ids = qgram_candidates(heavy_chunks, "_tk", heavy_items, "k", q).select(*_CHUNK).distinct()
    heavy = heavy_chunks.drop("_tk").join(hit_ids, _CHUNK, "left_semi")
    return light.unionByName(heavy.select(*light.columns))


def mask_chunks(chunks: DataFrame, items: DataFrame, max_inline_items: int = DEFAULT_MAX_INLINE_ITEMS,
                q: int = DEFAULT_Q, case_insensitive: bool = False) -> DataFrame:
    """M5-M8: masked text of every chunk of a document that has items.

    Returns ``doc_id, chunk_index, content``; chunks without an occurrence
    come back unchanged (:func:`write_back` flags the changed ones). No
    filter on the ranges here: it would be evaluated as well as projected.
    """
    r = ranges_per_chunk(chunks, items, max_inline_items, q, case_insensitive)
    return r.select(
        "doc_id", "chunk_index", apply_ranges_col("content", "ranges").alias("content")
    )


def masked_changes(chunks: DataFrame, items: DataFrame, max_inline_items: int = DEFAULT_MAX_INLINE_ITEMS,
                   q: int = DEFAULT_Q, case_insensitive: bool = False) -> DataFrame:
    """M5-M9 as a delta: only the chunks that masking changes, under their new text.

    ``chunks`` of documents without items are dropped by a semi-join before
    anything else. The masked text is computed in a generator, so that the
    filter on it cannot be pushed below and compute it a second time.
    """
    part = _part(chunks)
    extra = [c for c in chunks.columns if c not in (*part, "chunk_index", "content", "changed")]
    keyed = chunks.withColumn("_kept", F.struct(F.lit(0), *extra))
    r = ranges_per_chunk(keyed, items, max_inline_items, q, case_insensitive, keep=["_kept"])
    masked = F.explode_outer(F.array(apply_ranges_col("content", "ranges")))
    return (r.select(*part, "chunk_index", "_kept", F.col("content").alias("_was"), masked.alias("content"))
            .where(F.col("content") != F.col("_was")).select(*part, "chunk_index", "content", *[f"_kept.{c}" for c in extra]))


def mask_documents(chunks: DataFrame, items: DataFrame, max_inline_items: int = DEFAULT_MAX_INLINE_ITEMS,
                   q: int = DEFAULT_Q, case_insensitive: bool = False) -> DataFrame:
    """M5-M9 as one co-partitioned step: every chunk, masked where its document's items occur.

    Equal to ``write_back(chunks, mask_chunks(chunks, items))`` but keyed on
    ``doc_id`` only: chunks of documents without items pass through an
    anti-join, chunks of documents with items come out of the item join
    masked. With chunks hash-partitioned by their work unit (``doc_id`` or
    ``(doc_id, grp)``) and joined on that unit, neither side
    moves the text again (a join on ``(doc_id, chunk_index)`` would).
    Adds ``changed``.
    """
    part = _part(chunks)
    base = chunks.select(*part, "chunk_index", "content")
    r = ranges_per_chunk(base, items, max_inline_items, q, case_insensitive)
    masked = r.select(
        *part, "chunk_index", "content",
        apply_ranges_col("content", "ranges").alias("_masked"),
    ).select(*part, "chunk_index", F.col("_masked").alias("content"),
             (F.col("_masked") != F.col("content")).alias("changed"))
    ids = _per_part(base, items.select("doc_id").distinct()).select(*part)
    untouched = base.join(ids, part, "left_anti").withColumn("changed", F.lit(False))
    return untouched.unionByName(masked)


def write_back(chunks: DataFrame, masked: DataFrame) -> DataFrame:
    """M9: masked text replaces the chunk at (doc_id, chunk_index); other chunks unchanged.

    Adds ``changed`` (true where a masked version was written).
    """
    m = masked.select("doc_id", "chunk_index", F.col("content").alias("_masked"))
    out = chunks.join(m, ["doc_id", "chunk_index"], "left")
    return out.select(
        *[c for c in chunks.columns if c not in ("content", "changed")],
        F.coalesce(F.col("_masked"), F.col("content")).alias("content"),
        (F.col("_masked").isNotNull() & (F.col("_masked") != F.col("content"))).alias("changed"),
    )
