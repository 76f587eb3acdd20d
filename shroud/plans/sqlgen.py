"""DuckDB SQL fragments for the oracle queries.

Built from the same constants as the Spark expressions (patterns, fold
tables, rules) so the two sides cannot drift apart silently, but written
independently: the oracle uses joins, windows and ``unnest`` where the
Spark side uses in-row higher-order functions, so agreement is a real check.
RE2 notes: ``\\1`` for groups in replacements, ``chr(10)`` for newlines, no
look-around (``\\b`` is already an ASCII boundary in RE2).
"""

from __future__ import annotations

from shroud.functions import text as tx
from shroud.functions.fold import casefold_tables, fold_tables
from shroud.operators.chunk import DEFAULT_OVERLAP, DEFAULT_SIZE
from shroud.operators.detect import DEFAULT_RULES, PROMPT_TEMPLATE

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(col: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({col}, {lit(pattern)}, {repl}, 'g')"


# Entities that occur in the test pages; '&amp;' must be last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape(col: str) -> str:
    out = col
    for k, v in ENTITIES:
        out = f"replace({out}, {lit(k)}, {lit(v)})"
    return out


def clean(col: str) -> str:
    c = f"coalesce({col}, '')"
    c = rx(c, tx.HTML_COMMENT, "''")
    c = rx(c, tx.HTML_COMMENT, "''")
    c = rx(c, tx.HTML_TAG, "''")
    c = unescape(c)
    c = rx(c, tx.SPACE_RUN, "' '")
    c = rx(c, tx.NEWLINE_RUN, f"{NL} || {NL}")
    c = rx(c, tx.BROKEN_LABEL, r"'\1.:'")
    c = rx(c, tx.SPACE_BEFORE_PUNCT, r"'\1'")
    c = rx(c, tx.LINE_BREAK, NL)
    c = rx(c, r"\n\z", "''")
    return rx(c, tx.TRAILING_INLINE_SPACE, r"'\1'")


def py_strip(col: str) -> str:
    return rx(col, r"^[" + tx.PY_SPACE + r"]+|[" + tx.PY_SPACE + r"]+\z", "''")


def tidy(col: str) -> str:
    return rx(py_strip(col), r"\n+", "' '")


def visible(col: str) -> str:
    return f"regexp_matches({col}, {lit('[^' + tx.PY_SPACE + ']')})"


def fold(col: str) -> str:
    src, dst = fold_tables()
    return f"translate({col}, {lit(src)}, {lit(dst)})"


def casefold(col: str) -> str:
    src, dst, multi = casefold_tables()
    out = f"translate(lower({col}), {lit(src)}, {lit(dst)})"
    for a, b in multi:
        out = f"replace({out}, {lit(a)}, {lit(b)})"
    return out


def key(col: str) -> str:
    return casefold(fold(col))


# --- chunks -------------------------------------------------------------------------------


def chunk_rows(source: str, id_expr: str, text_expr: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP,
               tidy_pieces: bool = True, only_visible: bool = True) -> str:
    """``doc_id, chunk_index, content`` of fixed-window chunks (K2-K6) as a sub-query."""
    step = size - overlap
    piece = tidy("substr(t, p, %d)" % size) if tidy_pieces else "substr(t, p, %d)" % size
    pieces = f"list_transform(generate_series(1, greatest(length(t) - {overlap}, 1), {step}), lambda p: {piece})"
    if tidy_pieces:
        pieces = f"list_filter({pieces}, lambda x: x <> '')"
    inner = f"""
      SELECT doc_id, CASE WHEN length(t) < {size} THEN [t] ELSE {pieces} END AS pieces
      FROM (SELECT CAST({id_expr} AS VARCHAR) AS doc_id, {text_expr} AS t FROM {source}) d
      WHERE t IS NOT NULL AND length(t) > 0"""
    rows = f"""
    SELECT doc_id, CAST(unnest(generate_series(0, len(pieces) - 1)) AS INTEGER) AS chunk_index,
           unnest(pieces) AS content
    FROM ({inner}) x"""
    if only_visible:
        rows = f"SELECT * FROM ({rows}) y WHERE {visible('content')}"
    return rows


# --- detection ------------------------------------------------------------------------------


CHECKS = {
    # Luhn: from the right, every second digit doubled (minus 9 above 9); sum divisible by 10
    "luhn": ("list_sum(list_transform(range(1, length(m) + 1), lambda i: CASE WHEN i % 2 = 0 THEN "
             "(CASE WHEN 2 * CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) > 9 "
             "THEN 2 * CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) - 9 "
             "ELSE 2 * CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) END) "
             "ELSE CAST(substr(m, length(m) - i + 1, 1) AS INTEGER) END)) % 10 = 0"),
    "luhn_digits": ("list_sum(list_transform(string_split(reverse(regexp_replace(m, '[ -]', '', 'g')), ''), lambda d, i: "
                    "CASE WHEN i % 2 = 1 THEN CAST(d AS INTEGER) WHEN CAST(d AS INTEGER) > 4 THEN 2 * CAST(d AS INTEGER) - 9 "
                    "ELSE 2 * CAST(d AS INTEGER) END)) % 10 = 0"),
    "octets": "list_bool_and(list_transform(string_split(m, '.'), lambda o: CAST(o AS INTEGER) <= 255))",
}


def rule_items(col: str, rules=DEFAULT_RULES) -> str:
    parts = []
    for r in rules:
        item = (f"{{'text': x, 'category': {lit(r.category)}, 'type': {lit(r.type)}, "
                f"'justification': {lit(r.justification)}}}")
        matches = f"regexp_extract_all({col}, {lit(r.pattern)}, 0)"
        if r.check:
            matches = f"list_filter({matches}, lambda m: {CHECKS[r.check]})"
        parts.append(f"list_transform({matches}, lambda x: {item})")
    return " || ".join(parts)


def detections(chunks: str, round_: int | str = 0, rules=DEFAULT_RULES) -> str:
    """Detection rows of rule matches over a chunk sub-query."""
    return f"""
    SELECT doc_id, chunk_index, round, item_pos, it.text AS text, it.category AS category, it.type AS type,
           it.justification AS justification
    FROM (
      SELECT doc_id, chunk_index, CAST({round_} AS INTEGER) AS round,
             CAST(unnest(generate_series(0, len(items) - 1)) AS BIGINT) AS item_pos, unnest(items) AS it
      FROM (SELECT doc_id, chunk_index, {rule_items('content', rules)} AS items FROM ({chunks}) c) z
      WHERE len(items) > 0
    ) u"""


def prompt(col: str) -> str:
    return f"replace({lit(PROMPT_TEMPLATE)}, '{{text}}', {col})"


# --- masking ----------------------------------------------------------------------------------


def ranges(chunks: str, dets: str) -> str:
    """Every occurrence range (0-based [s, e)) of a document's items in its chunks."""
    return f"""
    WITH items AS (SELECT DISTINCT doc_id, text FROM ({dets}) d WHERE text IS NOT NULL),
    fitems AS (SELECT doc_id, text, {fold('text')} AS fi, length(text) AS li FROM items),
    cand AS (
      SELECT c.doc_id, c.chunk_index, c.content, {fold('c.content')} AS ft, i.fi, i.li
      FROM ({chunks}) c JOIN fitems i ON c.doc_id = i.doc_id
      WHERE length(i.fi) > 0
    ),
    pos AS (
      SELECT doc_id, chunk_index, content, ft, fi, li,
             unnest(generate_series(1, greatest(length(ft) - length(fi) + 1, 1))) AS p
      FROM cand WHERE contains(ft, fi)
    )
    SELECT doc_id, chunk_index, CAST(p - 1 AS INTEGER) AS s, CAST(p - 1 + li AS INTEGER) AS e
    FROM pos
    WHERE substr(ft, p, length(fi)) = fi AND {fold('substr(content, p, li)')} = fi"""


def merged(range_rows: str) -> str:
    """Gaps and islands: overlapping or touching ranges merged per chunk."""
    return f"""
    WITH r AS ({range_rows}),
    o AS (
      SELECT *, max(e) OVER (PARTITION BY doc_id, chunk_index ORDER BY s, e
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end
      FROM r
    ),
    f AS (SELECT *, CASE WHEN prev_end IS NULL OR s > prev_end THEN 1 ELSE 0 END AS new_island FROM o),
    i AS (SELECT *, sum(new_island) OVER (PARTITION BY doc_id, chunk_index ORDER BY s, e
                                          ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT doc_id, chunk_index, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, chunk_index, island"""


def masked(chunks: str, merged_rows: str) -> str:
    """All chunks with masked text written back; ``changed`` marks the rewritten ones."""
    return f"""
    WITH c AS ({chunks}),
    m AS ({merged_rows}),
    seg AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id, chunk_index ORDER BY s), 0) AS pe FROM m),
    mk AS (
      SELECT seg.doc_id, seg.chunk_index,
             string_agg(substr(c.content, pe + 1, s - pe) || repeat('*', e - s), '' ORDER BY s)
               || substr(any_value(c.content), max(e) + 1) AS masked
      FROM seg JOIN c ON seg.doc_id = c.doc_id AND seg.chunk_index = c.chunk_index
      GROUP BY seg.doc_id, seg.chunk_index
    )
    SELECT c.doc_id, c.chunk_index, coalesce(mk.masked, c.content) AS content,
           (mk.masked IS NOT NULL AND mk.masked <> c.content) AS changed
    FROM c LEFT JOIN mk ON c.doc_id = mk.doc_id AND c.chunk_index = mk.chunk_index"""


def exists_items(chunks: str, dets: str) -> str:
    """Chunks holding (folded, case-folded) at least one item of their document."""
    return f"""
    WITH k AS (SELECT DISTINCT doc_id, {key('text')} AS k FROM ({dets}) d WHERE text IS NOT NULL),
    c AS ({chunks})
    SELECT c.doc_id, c.chunk_index, c.content FROM c
    WHERE length(c.content) > 0 AND EXISTS (
      SELECT 1 FROM k WHERE k.doc_id = c.doc_id AND length(k.k) > 0 AND contains({key('c.content')}, k.k))"""


# --- findings -----------------------------------------------------------------------------------


def findings(dets: str) -> str:
    """First occurrence per (doc, text_category) among unmasked items."""
    return f"""
    WITH d AS (SELECT * FROM ({dets}) x WHERE NOT contains(coalesce(text, ''), '****')),
    r AS (
      SELECT *, row_number() OVER (
        PARTITION BY doc_id, coalesce(text, '') || '_' || coalesce(category, '')
        ORDER BY round, chunk_index, item_pos) AS rn
      FROM d
    )
    SELECT doc_id AS id, round, chunk_index, item_pos, text, category, type, justification FROM r WHERE rn = 1"""


def two_rounds(chunks: str, only: str = "") -> str:
    """Round 0 on all chunks; mask with round-0 items; round 1 on the changed chunks.

    ``only`` is a condition on what a round reports of a chunk's items.
    """
    def detections(c, r):
        return f"SELECT * FROM ({globals()['detections'](c, r)}) only_ {only}"

    d0 = detections(chunks, 0)
    m = masked(chunks, merged(ranges(chunks, d0)))
    changed = f"SELECT doc_id, chunk_index, content FROM ({m}) mm WHERE changed AND {visible('content')}"
    d1 = detections(changed, 1)
    return f"SELECT * FROM ({d0}) a UNION ALL SELECT * FROM ({d1}) b"
