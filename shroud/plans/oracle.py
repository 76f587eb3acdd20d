"""DuckDB oracle statements, one per registered query."""

from __future__ import annotations

from shroud.functions.payload import FENCE_CLOSE, FENCE_OPEN
from shroud.operators.detect import DEFAULT_RULES, MORE_RULES, with_checks
from shroud.plans import sqlgen as S
from shroud.plans import sqlsplit
from shroud.plans.file_queries import FILE_ORACLE
from shroud.plans.queries import DICTIONARY_TERMS

ITEMS_JSON_TYPE = '[{"text":"VARCHAR","category":"VARCHAR","type":"VARCHAR","justification":"VARCHAR"}]'
JSON_WS = r"[ \t\n\r]"


def _chunks(tidy: bool = True) -> str:
    return S.chunk_rows("documents", "doc_id", "text", tidy_pieces=tidy, only_visible=tidy)


def _round0() -> str:
    return S.detections(_chunks(), 0)


def _fence(col: str) -> str:
    return f"({S.lit(FENCE_OPEN)} || {col} || {S.lit(FENCE_CLOSE)})"


def _strip_fence(col: str, require: bool) -> str:
    n_open, n_close = len(FENCE_OPEN), len(FENCE_CLOSE)
    cond = (f"starts_with({col}, {S.lit(FENCE_OPEN)}) AND ends_with({col}, {S.lit(FENCE_CLOSE)}) "
            f"AND length({col}) >= {n_open + n_close}")
    inner = S.py_strip(f"substr({col}, {n_open + 1}, length({col}) - {n_open + n_close})")
    return f"CASE WHEN {cond} THEN {inner} ELSE {'NULL' if require else col} END"


def _parse(col: str) -> str:
    shaped = f"regexp_matches({col}, {S.lit('(?s)^' + JSON_WS + r'*\[.*\]' + JSON_WS + r'*\z')})"
    parsed = f"try(from_json({col}, {S.lit(ITEMS_JSON_TYPE)}))"
    return f"CASE WHEN {shaped} AND len({parsed}) > 0 THEN {parsed} END"


def _payloads(dets: str) -> str:
    return f"""
    SELECT doc_id, round, chunk_index, CAST(count(*) AS INTEGER) AS n_items,
           CAST(to_json(list({{'text': text, 'category': category, 'type': type, 'justification': justification}}
                        ORDER BY item_pos)) AS VARCHAR) AS payload,
           string_agg(text || chr(9) || category, chr(10) ORDER BY item_pos) AS items_text
    FROM ({dets}) d GROUP BY doc_id, round, chunk_index"""


def _payload_parse() -> str:
    answers = {
        "fenced": _fence("payload"),
        "bare": "payload",
        "empty": _fence("'[]'"),
        "object": _fence("CAST(to_json(from_json(payload, '" + ITEMS_JSON_TYPE + "')[1]) AS VARCHAR)"),
        "truncated": _fence("substr(payload, 1, length(payload) - 2)"),
        "trailing": _fence("payload || 'x'"),
        "twice": _fence("payload || payload"),
        "listed": _fence("payload || ', ' || payload"),
        "after": _fence("payload || ' [1]'"),
        "closed": _fence("payload || '] [1]'"),
    }
    payloads = _payloads(_round0())
    variants = " UNION ALL ".join(
        f"SELECT doc_id, chunk_index, {S.lit(k)} AS variant, {v} AS answer FROM ({payloads}) p"
        for k, v in answers.items())
    modes = " UNION ALL ".join(
        f"SELECT doc_id, chunk_index, variant, {S.lit(m)} AS mode, {_parse(_strip_fence('answer', req))} AS items "
        f"FROM ({variants}) v" for m, req in (("detect", True), ("combine", False)))
    return f"""
    SELECT doc_id, chunk_index, variant, mode, item_pos, it.text AS text, it.category AS category,
           it.type AS type, it.justification AS justification
    FROM (SELECT doc_id, chunk_index, variant, mode,
                 CAST(unnest(generate_series(0, len(items) - 1)) AS BIGINT) AS item_pos, unnest(items) AS it
          FROM ({modes}) x WHERE items IS NOT NULL) y"""


def _answer_rejects() -> str:
    """The variants that are rejected, by what is wrong with each (payloads themselves are good)."""
    wrong = [("bare", "detect", "no fence"), ("object", "detect", "not a JSON array"), ("object", "combine", "not a JSON array"),
             ("truncated", "detect", "not a JSON array"), ("truncated", "combine", "not a JSON array"),
             ("trailing", "detect", "not a JSON array"), ("trailing", "combine", "not a JSON array")]
    wrong += [(v, m, "invalid JSON") for v in ("twice", "listed", "after", "closed") for m in ("detect", "combine")]
    rows = ", ".join(f"({S.lit(v)}, {S.lit(m)}, {S.lit(r)})" for v, m, r in wrong)
    return f"""SELECT doc_id, chunk_index, variant, mode, reason
               FROM (SELECT DISTINCT doc_id, chunk_index FROM ({_round0()}) d), (VALUES {rows}) w(variant, mode, reason)"""


def _dictionary() -> str:
    terms = " UNION ALL ".join(
        f"SELECT {S.lit(t)} AS term, {S.lit(c)} AS category, {S.lit(ty)} AS type, {S.lit(j)} AS justification"
        for t, c, ty, j in DICTIONARY_TERMS)
    return f"""
    WITH t AS (SELECT {S.key('term')} AS key, category, type, justification FROM ({terms}) x),
    tok AS (
      SELECT doc_id, chunk_index, CAST(unnest(generate_series(0, len(toks) - 1)) AS BIGINT) AS item_pos,
             unnest(toks) AS text
      FROM (SELECT doc_id, chunk_index, regexp_extract_all(content, {S.lit(r'[\p{L}\p{N}_]+')}, 0) AS toks
            FROM ({_chunks()}) c) z WHERE len(toks) > 0
    ),
    -- folding and case-folding leave ASCII to plain lower(); key each distinct token once
    dk AS (
      SELECT text, CASE WHEN regexp_matches(text, '^[\x00-\x7f]*$') THEN lower(text) ELSE {S.key('text')} END AS key
      FROM (SELECT DISTINCT text FROM tok) u
    )
    SELECT doc_id, chunk_index, 0 AS round, item_pos, tok.text, t.category, t.type, t.justification
    FROM tok JOIN dk ON tok.text = dk.text JOIN t ON dk.key = t.key"""


def _phrases() -> str:
    """Multi-word dictionary: token list + separator list per chunk, first-token equi-join, rest checked."""
    from shroud.functions.text import PY_SPACE
    from shroud.plans.queries import PHRASE_TERMS

    tok = r"[\p{L}\p{N}_]+"
    sep = r"[^\p{L}\p{N}_]+"
    def fast_key(x):
        return f"CASE WHEN regexp_matches({x}, '^[\x00-\x7f]*$') THEN lower({x}) ELSE {S.key(x)} END"
    terms = " UNION ALL ".join(
        f"SELECT {S.lit(t)} AS term, {S.lit(c)} AS category, {S.lit(ty)} AS type, {S.lit(j)} AS justification"
        for t, c, ty, j in PHRASE_TERMS)
    return f"""
    WITH t AS (
      SELECT list_transform(regexp_extract_all(term, {S.lit(tok)}, 0), lambda w: {S.key('w')}) AS keys,
             category, type, justification FROM ({terms}) x
    ),
    firsts AS (SELECT DISTINCT keys[1] AS k FROM t),
    c AS (
      SELECT * FROM ({_chunks()}) c0
      WHERE EXISTS (SELECT 1 FROM firsts WHERE contains({S.key('c0.content')}, firsts.k))
    ),
    tk AS (
      SELECT doc_id, chunk_index, regexp_extract_all(content, {S.lit(tok)}, 0) AS toks,
             regexp_extract_all(content, {S.lit(sep)}, 0) AS seps,
             CASE WHEN regexp_matches(content, {S.lit('^' + tok)}) THEN 0 ELSE 1 END AS off
      FROM c
    ),
    keyed AS (SELECT *, list_transform(toks, lambda w: {fast_key('w')}) AS keys_ FROM tk),
    pos AS (SELECT doc_id, chunk_index, toks, seps, off, keys_, unnest(generate_series(1, len(toks))) AS j FROM keyed)
    SELECT doc_id, chunk_index, 0 AS round, CAST(j - 1 AS BIGINT) AS item_pos,
           toks[j] || array_to_string(list_transform(range(1, len(t.keys)), lambda k: seps[j + k - 1 + off] || toks[j + k]), '') AS text,
           t.category, t.type, t.justification
    FROM pos JOIN t ON pos.keys_[j] = t.keys[1]
    WHERE j + len(t.keys) - 1 <= len(toks)
      AND coalesce(list_bool_and(list_transform(range(1, len(t.keys)), lambda k:
            keys_[j + k] = t.keys[k + 1] AND regexp_full_match(seps[j + k - 1 + off], {S.lit('[' + PY_SPACE + ']+')}))), true)"""


def _corpus_paths() -> str:
    endings = [".txt", ".md", ".docx", ".pdf", ".rtf", ".odt", ".TXT", ".html", "", ".tar.gz", ".Md", ".json"]
    arr = "[" + ", ".join(S.lit(e) for e in endings) + "]"
    return f"""
    SELECT '/corpus/' || source || '/' || lang || '/doc-' || CAST(doc_id AS VARCHAR) || {arr}[doc_id % {len(endings)} + 1]
             AS path, encode(text) AS content, n_chars AS length
    FROM documents"""


def _ext(col: str) -> str:
    base = f"regexp_extract({col}, '[^/]*$', 0)"
    return f"lower(regexp_extract({base}, {S.lit(r'^\.*[^.].*(\.[^.]*)$')}, 1))"


def _mime(path: str, content: str) -> str:
    from shroud.sources.files import KNOWN_TYPES, mime_table

    table = mime_table()
    keys = "[" + ", ".join(S.lit(k) for k in sorted(table)) + "]"
    vals = "[" + ", ".join(S.lit(table[k]) for k in sorted(table)) + "]"
    head = f"decode({content})"
    return (f"coalesce(map_from_entries(list_zip({keys}, {vals}))[{_ext(path)}], "
            f"CASE WHEN starts_with({head}, '%PDF') THEN 'application/pdf' "
            f"WHEN starts_with({head}, 'PK' || chr(3) || chr(4)) AND ends_with({path}, '.docx') "
            f"THEN {S.lit(KNOWN_TYPES['.docx'])} END, 'application/octet-stream')")


def oracle_sql() -> dict[str, str]:
    chunks = _chunks()
    r0 = _round0()
    two = S.two_rounds(chunks)
    pages_chunks = S.chunk_rows("pages", "page_id", S.clean("html"))
    conv_chunks = S.chunk_rows("conversations", "CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)", "text")
    return {
        "load_documents": f"""
            SELECT CAST(doc_id AS VARCHAR) AS id, 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS name,
                   'text/plain' AS type, {S.clean('text')} AS content
            FROM documents WHERE text IS NOT NULL AND length(text) > 0""",
        "clean_pages": f"SELECT page_id, {S.clean('html')} AS content FROM pages",
        "chunk_fixed": _chunks(tidy=False),
        "chunk_tidy": chunks,
        "chunk_recursive": sqlsplit.recursive_rows("documents", "doc_id", "text"),
        "scan_documents": sqlsplit.over_chunks(sqlsplit.recursive_rows("documents", "doc_id", S.clean("text")),
                                               S.findings(S.two_rounds("SELECT * FROM chunk_rows"))),
        "chunk_short": f"""SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars
                           FROM ({_chunks(tidy=False)}) c GROUP BY doc_id""",
        "detect_rules": r0,
        "detect_rules_more": S.detections(chunks, 0, MORE_RULES),
        "answer_rejects": _answer_rejects(),
        "detect_rules_checked": S.detections(chunks, 0, with_checks()),
        "detect_rules_pages": S.detections(pages_chunks, 0),
        "detect_rules_conversations": S.detections(conv_chunks, 0),
        "detect_dictionary": _dictionary(),
        "detect_dictionary_phrases": _phrases(),
        "prompt_column": f"SELECT doc_id, chunk_index, {S.prompt('content')} AS prompt FROM ({chunks}) c",
        "payload_parse": _payload_parse(),
        "group_items": f"SELECT doc_id, round, chunk_index, n_items, items_text FROM ({_payloads(r0)}) p",
        "combine_items": f"SELECT doc_id, round, chunk_index, item_pos, text, category, type, justification FROM ({two}) t",
        "fold_text": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, {S.fold('text')} AS folded,
                                {S.key('text')} AS match_key FROM documents""",
        "chunks_with_items": S.exists_items(chunks, r0),
        "match_ranges": f"SELECT DISTINCT doc_id, chunk_index, s, e FROM ({S.ranges(chunks, r0)}) r",
        "merged_ranges": S.merged(S.ranges(chunks, r0)),
        "mask_documents": S.masked(chunks, S.merged(S.ranges(chunks, r0))),
        "mask_documents_indexed": S.masked(chunks, S.merged(S.ranges(chunks, r0))),
        "chunks_with_items_indexed": S.exists_items(chunks, r0),
        "two_rounds": two,
        "stage_counts": f"""
            SELECT 'documents' AS stage, count(*) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0
            UNION ALL SELECT 'chunks', count(*) FROM ({_chunks(tidy=False)}) a
            UNION ALL SELECT 'examined', count(*) FROM ({chunks}) b
            UNION ALL SELECT 'items', count(*) FROM ({r0}) c
            UNION ALL SELECT 'unique_items', count(*) FROM ({S.findings(r0)}) d""",
        "findings": S.findings(two),
        "two_rounds_first_match": S.two_rounds(chunks, "WHERE item_pos = 0"),
        "findings_first_match": S.findings(S.two_rounds(chunks, "WHERE item_pos = 0")),
        **FILE_ORACLE,
        "combine_with_function": f"""
            SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round, chunk_index, item_pos) - 1 AS item_pos,
                   text, category, type, justification FROM ({two}) t""",
        "findings_nested": f"""
            WITH d0 AS ({r0}),
            d AS (
              SELECT * REPLACE (CASE WHEN doc_id::BIGINT % 5 = 0 THEN '****' || text ELSE text END AS text) FROM d0
              UNION ALL SELECT * REPLACE ('x****' || text AS text, 1 AS round) FROM d0 WHERE doc_id::BIGINT % 3 = 0),
            f AS (
              SELECT id, count(*) AS n, string_agg(text || '|' || category || '|' || type || '|' || justification, ';'
                                                   ORDER BY round, chunk_index, item_pos) AS items
              FROM ({S.findings('SELECT * FROM d')}) g GROUP BY id)
            SELECT i.id, coalesce(f.n, 0) AS n_items, coalesce(f.items, '') AS items
            FROM (SELECT DISTINCT doc_id AS id FROM d) i LEFT JOIN f ON i.id = f.id""",
        "file_listing": """
            SELECT lang, source, CAST(sum(length(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) + 1) AS BIGINT)
                     AS n_chars,
                   CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines
            FROM documents WHERE text IS NOT NULL GROUP BY lang, source""",
        "scan_pages": S.findings(S.two_rounds(S.chunk_rows("pages", "page_id", S.clean("html")))),
        "scan_documents_fixed": S.findings(S.two_rounds(S.chunk_rows("documents", "doc_id", S.clean("text")))),
        "model_detect": S.detections(chunks, 0, DEFAULT_RULES[:1]),
        "file_mime": f"SELECT path, {_ext('path')} AS ext, {_mime('path', 'content')} AS mime FROM ({_corpus_paths()}) p",
        "file_ids": f"""SELECT path, length, CAST(row_number() OVER (ORDER BY length, path) - 1 AS VARCHAR) AS file_id
                        FROM ({_corpus_paths()}) p""",
    }
