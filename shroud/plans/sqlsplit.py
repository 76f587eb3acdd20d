"""The recursive splitter (K1) as DuckDB SQL, written from its rules as relations.

One common table expression per separator holds the spans still to be cut. A
span that holds the separator falls into pieces (a running sum of their lengths
gives the positions); long pieces are spans of the next separator, runs of short
ones between them are merged. A window that begins at piece i ends before the
first piece that no longer fits, and the next window begins at the first piece
that keeps both the overlap and that piece's fit: two as-of joins on positions.
The windows of a run are the chain of these pointers from its first piece.
"""

from __future__ import annotations

from shroud.operators.chunk import DEFAULT_OVERLAP, DEFAULT_SEPARATORS, DEFAULT_SIZE
from shroud.plans import sqlgen as S

RUN = "doc_id, lvl, parent, run"


def _level(k: int, sep: str, size: int) -> str:
    if sep == "":
        pieces = f"SELECT doc_id, s AS parent, s + i AS a, s + i + 1 AS b FROM (SELECT doc_id, s, unnest(range(e - s)) AS i FROM c{k}) u"
        left = f"SELECT doc_id, s, e FROM c{k} WHERE false"
    else:
        quoted = "'" + sep.replace("\n", "' || chr(10) || '") + "'"
        lengths = f"list_transform(string_split(x, {quoted}), lambda q, i: length(q) + CASE WHEN i > 1 THEN {len(sep)} ELSE 0 END)"
        pieces = f"""
          SELECT doc_id, parent, a, a + len AS b FROM (
            SELECT doc_id, s AS parent, len, s + coalesce(sum(len) OVER (
                     PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
            FROM (SELECT doc_id, s, unnest(range(len(lens))) AS i, unnest(lens) AS len
                  FROM (SELECT doc_id, s, {lengths} AS lens FROM c{k} WHERE contains(x, {quoted})) y) z) w
          WHERE len > 0"""
        left = f"SELECT doc_id, s, e FROM c{k} WHERE NOT contains(x, {quoted})"
    return f"""
    c{k} AS (SELECT doc_id, s, e, substr(t, s, e - s) AS x FROM s{k} JOIN docs USING (doc_id)),
    p{k} AS ({pieces}),
    r{k} AS (SELECT *, {k} AS lvl, sum((b - a >= {size})::INTEGER) OVER (PARTITION BY doc_id, parent ORDER BY a) AS run FROM p{k}),
    s{k + 1} AS ({left} UNION ALL SELECT doc_id, a, b FROM p{k} WHERE b - a >= {size}),"""


def recursive_rows(source: str, id_expr: str, text_expr: str, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP,
                   separators=DEFAULT_SEPARATORS) -> str:
    """``doc_id, chunk_index, content`` of the recursive splitter with tidy-up; ``separators`` ends with ''."""
    levels = "".join(_level(k, sep, size) for k, sep in enumerate(separators))
    runs = " UNION ALL ".join(f"SELECT {RUN}, a, b FROM r{k} WHERE b - a < {size}" for k in range(len(separators)))
    same = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in RUN.split(", "))
    return f"""
    WITH RECURSIVE docs AS (
      SELECT * FROM (SELECT CAST({id_expr} AS VARCHAR) AS doc_id, {text_expr} AS t FROM {source}) d0 WHERE length(t) > 0),
    s0 AS (SELECT doc_id, 1::BIGINT AS s, length(t) + 1 AS e FROM docs WHERE length(t) >= {size}),
    {levels}
    runs AS ({runs}),
    ends AS (SELECT {RUN}, min(a) AS first, max(b) AS last FROM runs GROUP BY {RUN}),
    cut AS (SELECT i.*, j.a AS ja, j.b AS jb FROM runs i ASOF LEFT JOIN runs j ON {same.format('i', 'j')} AND i.a + {size} < j.b),
    back AS (
      SELECT i.doc_id, i.lvl, i.parent, i.run, i.a, i.ja, n.a AS next
      FROM (SELECT *, greatest(ja - {overlap}, jb - {size}) AS least_a FROM cut WHERE ja IS NOT NULL) i
      ASOF JOIN runs n ON {same.format('i', 'n')} AND i.least_a <= n.a),
    chain AS (
      SELECT {RUN}, first AS a FROM ends
      UNION ALL
      SELECT b.doc_id, b.lvl, b.parent, b.run, b.next FROM chain c JOIN back b ON {same.format('c', 'b')} AND c.a = b.a),
    windows AS (
      SELECT c.doc_id, c.a, coalesce(b.ja, e.last) AS z FROM chain c JOIN ends e ON {same.format('c', 'e')}
      LEFT JOIN back b ON {same.format('c', 'b')} AND c.a = b.a),
    tidied AS (SELECT doc_id, a, {S.tidy('substr(t, a, z - a)')} AS content FROM windows JOIN docs USING (doc_id))
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS chunk_index, content FROM tidied WHERE content <> ''
    UNION ALL SELECT doc_id, 0, t FROM docs WHERE length(t) < {size}"""


def over_chunks(chunks: str, query: str) -> str:
    """``query`` over a table named ``chunk_rows``, computed once."""
    return f"WITH chunk_rows AS MATERIALIZED ({chunks}) SELECT * FROM ({query}) q"
