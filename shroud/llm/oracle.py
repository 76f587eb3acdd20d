"""DuckDB SQL with the results of the queries that SQL can express."""

#: One level of water-filling: {key} are the parent's columns, {level} the child's.
_LEVEL = """
{name}_w AS (
  SELECT *, coalesce(sum(capacity) OVER b, 0)::HUGEINT AS c_before, coalesce(sum(weight) OVER b, 0)::HUGEINT AS w_before,
         sum(weight) OVER (PARTITION BY {parent})::HUGEINT AS w_all
  FROM {name}_n
  WINDOW b AS (PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight, {level}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_f AS (
  SELECT *, c_before * weight + capacity * (w_all - w_before) <= budget::HUGEINT * weight AS filled FROM {name}_w),
{name}_s AS (
  SELECT *, coalesce(sum(CASE WHEN filled THEN capacity END) OVER (PARTITION BY {parent}), 0)::HUGEINT AS c_full,
         coalesce(sum(CASE WHEN filled THEN weight END) OVER (PARTITION BY {parent}), 0)::HUGEINT AS w_full
  FROM {name}_f),
{name} AS (
  SELECT *, (CASE WHEN filled THEN capacity ELSE (budget - c_full) * weight // (w_all - w_full) END)::BIGINT AS given
  FROM {name}_s),
"""

MIXING = (
    """
WITH k AS (
  SELECT doc_id, 'd' || substr(md5(source), 1, 1) AS domain, lang AS language, source AS leaf_source, text,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))::BIGINT AS tokens
  FROM documents),
leaves AS (
  SELECT domain, language, leaf_source, sum(tokens)::BIGINT AS tokens FROM k GROUP BY ALL HAVING sum(tokens) > 0),
top_n AS (
  SELECT domain, sum(tokens) * 4 AS capacity, 100 AS weight,
         (SELECT sum(tokens) * 120 // 100 FROM leaves) AS budget
  FROM leaves GROUP BY domain),
"""
    + _LEVEL.replace("{name}", "top").replace("{parent}", "1").replace("{level}", "domain")
    + """
mid_n AS (
  SELECT l.domain, l.language, sum(l.tokens) * 4 AS capacity, any_value(t.given) AS budget,
         CASE l.language {weights} ELSE 100 END AS weight
  FROM leaves l JOIN top t USING (domain) GROUP BY l.domain, l.language),
"""
    + _LEVEL.replace("{name}", "mid").replace("{parent}", "domain").replace("{level}", "language")
    + """
low_n AS (
  SELECT l.domain, l.language, l.leaf_source, l.tokens, l.tokens * 4 AS capacity, m.given AS budget, 100 AS weight
  FROM leaves l JOIN mid m USING (domain, language)),
"""
    + _LEVEL.replace("{name}", "low").replace("{parent}", "domain, language").replace("{level}", "leaf_source")
    + """
plan AS (
  SELECT domain, language, leaf_source, given // tokens AS whole, given % tokens AS rest FROM low),
d AS (SELECT k.*, plan.whole, plan.rest FROM k JOIN plan USING (domain, language, leaf_source) WHERE k.tokens > 0),
c AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, language, leaf_source
                                       ORDER BY md5('17:' || whole || ':' || doc_id)
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d)
SELECT doc_id, domain, language, leaf_source, unnest(range(whole)) AS epoch, tokens, tokens AS take FROM d
UNION ALL
SELECT doc_id, domain, language, leaf_source, whole AS epoch, tokens, least(tokens, rest - before)::BIGINT AS take
FROM c WHERE before < rest
"""
)

#: One rule of the secret scan: its matches with their starts.
_RULE = """
SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS v,
       unnest(gs[:len(ms)]) AS g
FROM (SELECT doc_id, regexp_extract_all(tx, {re}) AS ms, regexp_extract_all(tx, {re}, {group}) AS vs,
             string_split_regex(tx, {re}) AS gs FROM t)
"""

_ASSIGN = "'(?i)(password|passwd|secret|token|api_?key)[\"\'\']?\\x20*[:=]\\x20*[\"\'\']?([A-Za-z0-9+/_.=-]+)'"
_RULES = [
    ("assign", _ASSIGN, 2),
    ("access", "'AKIA[A-Z0-9]{12,}'", 0),
    ("hex", "'[0-9a-f]{32,}'", 0),
    ("pem", "'-----BEGIN [A-Z ]*PRIVATE KEY-----'", 0),
    ("jwt", "'eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}'", 0),
]

SECRETS = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS tx FROM documents),\nm AS ("
    + "UNION ALL".join(
        _RULE.replace("{kind}", k).replace("{rank}", str(i)).replace("{re}", e).replace("{group}", str(g))
        for i, (k, e, g) in enumerate(_RULES))
    + """),
p AS (
  SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS e FROM m),
f AS (
  SELECT doc_id, kind, rank, (e - length(m))::BIGINT AS s, kind || ':' || (e - length(m)) || ':' || e AS span
  FROM p WHERE kind <> 'assign' OR length(v) >= 8),
a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(span, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)
"""
)

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


def _crc_table() -> list[int]:
    """The remainders of all bytes by the reflected CRC-32 polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _least_draw(children: list[tuple[str, str]], columns: str) -> str:
    """The child with the least draw; all weigh alike, so the weights cancel."""
    draw = "-ln((('0x' || substr(md5('{path}:' || key), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
    listed = ", ".join(f"{{'draw': {draw.replace('{path}', path)} / {weight}, 'name': '{path.rpartition('/')[2]}'}}" for path, weight in children)
    return f"list_min([{listed}]).name AS {columns}"


def _descent(regions: dict[str, dict[str, list[int]]], alias: str) -> str:
    """CASE expressions over the three levels of a tree of shards of weight 1."""
    size = {r: sum(len(s) for s in racks.values()) for r, racks in regions.items()}
    region = _least_draw([(f"/{r}", size[r]) for r in sorted(regions)], "region")
    rack = " ".join(f"WHEN '{r}' THEN ({_least_draw([(f'/{r}/{k}', len(s)) for k, s in sorted(racks.items())], 'x').removesuffix(' AS x')})"
                    for r, racks in regions.items())
    shard = " ".join(
        f"WHEN '{r}/{k}' THEN ({_least_draw([(f'/{r}/{k}/{i}', 1) for i in sorted(s)], 'x').removesuffix(' AS x')})"
        for r, racks in regions.items() for k, s in racks.items())
    return f"""
{alias}_1 AS (SELECT *, {region} FROM k),
{alias}_2 AS (SELECT *, CASE region {rack} END AS rack FROM {alias}_1),
{alias} AS (SELECT row, (CASE region || '/' || rack {shard} END)::INTEGER AS shard FROM {alias}_2)"""


_EIGHT = {"g0": {"r0": [0, 1], "r1": [2, 3]}, "g1": {"r0": [4, 5], "r1": [6, 7]}}

HASH_TREE = f"""
WITH k AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key,
         coalesce(strlen(text), 0)::BIGINT + 1 AS size,
         xor(4294967295::BIGINT, list_reduce(
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT),
           lambda a, x: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, x) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM documents),
{_descent(_EIGHT, 'old')},
{_descent({**_EIGHT, 'of 8': {'r0': [8]}}, 'grown')}
SELECT doc_id, size, text_crc32, 'key' AS law, old.shard AS shard,
       row_number() OVER (PARTITION BY old.shard ORDER BY md5(key || '|' || size || '|' || text_crc32), doc_id, size, text_crc32) - 1 AS slot,
       grown.shard AS grown_shard
FROM k JOIN old USING (row) JOIN grown USING (row)
"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
c AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>')
                OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, substr(x, 1, least(c1, c2)) AS pre,
         substr(x, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS mid, substr(x, greatest(c1, c2) + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE x END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM p
"""
