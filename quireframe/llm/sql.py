"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality, secrets

_SPACE = r"[^\x20\x09-\x0D]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w[i:i + 9], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT least(n, 10) AS k FROM g),
o AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lens WHERE len(w) >= k)),
h AS (SELECT DISTINCT o.doc_id, o.i, o.k, g.item_id FROM o JOIN g ON o.gram = g.gram AND o.k = least(g.n, 10)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_SIZED = rf"""
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) AS BIGINT) AS size,
             md5('{mixing.SEED}' || chr(31) || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS r FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS w FROM s),
s2 AS (SELECT *, row_number() OVER byc AS i,
              CAST(sum(source_size) OVER () - {mixing.CAP} * coalesce(sum(source_size) OVER (byc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / CAST(sum(w) OVER () - coalesce(sum(w) OVER (byc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
       FROM s1 WINDOW byc AS (ORDER BY source_size / w, source NULLS LAST)),
s3 AS (SELECT *, min(CASE WHEN level * w <= CAST({mixing.CAP} * source_size AS DOUBLE) THEN i END) OVER () AS f FROM s2),
s4 AS (SELECT source, n_docs, CAST(source_size AS BIGINT) AS source_size,
              CASE WHEN f IS NULL OR i < f THEN CAST({mixing.CAP} * source_size AS DOUBLE)
                   ELSE max(CASE WHEN i = f THEN level END) OVER () * w END AS target FROM s3),
g AS (SELECT d.source, {", ".join(f"sum(CASE WHEN d.size * {k} > s4.source_size THEN d.size ELSE 0 END) AS g{k}" for k in mixing.LONG)} FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source GROUP BY d.source),
w AS (SELECT s4.*, g.* EXCLUDE (source), CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS alike FROM s4 JOIN g ON g.source IS NOT DISTINCT FROM s4.source),
x AS (SELECT *, floor(alike + 0.5::DOUBLE) AS whole FROM w),
y AS (SELECT *, CASE {" ".join(f"WHEN source_size > g{k} AND (target - whole * CAST(g{k} AS DOUBLE)) / CAST(source_size - g{k} AS DOUBLE) BETWEEN 0 AND {mixing.CAP} THEN {k}" for k in mixing.LONG)} ELSE 0 END AS tier FROM x),
z AS (SELECT source, n_docs, source_size, target, whole, tier, CASE tier {" ".join(f"WHEN {k} THEN (target - whole * CAST(g{k} AS DOUBLE)) / CAST(source_size - g{k} AS DOUBLE)" for k in mixing.LONG)} ELSE alike END AS each FROM y),
e AS (SELECT d.doc_id, d.source, d.size, d.r, z.source_size, z.target, z.whole, z.each, d.size * z.tier > z.source_size AS is_long,
             CAST('0x' || substr(d.r, 1, 8) AS BIGINT) % greatest(1, CAST(floor(sqrt(n_docs) / 8) AS BIGINT)) AS bucket
      FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source),
a AS (SELECT *, row_number() OVER (PARTITION BY source, is_long ORDER BY bucket, CASE WHEN bucket % 2 = 0 THEN -size ELSE size END, r) AS pos,
             CAST(CAST('0x' || substr(md5('{mixing.SEED}' || chr(31) || coalesce(source, 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0::DOUBLE AS u
      FROM e)
"""

OP5 = rf"""
WITH {_SIZED}
SELECT doc_id, size, source_size, target, CAST(size * CASE WHEN is_long THEN whole ELSE floor(pos * each + u) - floor((pos - 1) * each + u) END AS BIGINT) AS taken FROM a
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind(order: int, rule: secrets.Rule) -> str:
    p = _quoted(rule.pattern)
    return (
        f"SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, unnest(range(1, len(m) + 1)) AS i, "
        f"string_split_regex(text, {p}) AS pieces, m, regexp_extract_all(text, {p}, {rule.group}) AS v "
        f"FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS m FROM d) WHERE len(m) > 0"
    )


OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS ({" UNION ALL ".join(_kind(i, r) for i, r in enumerate(secrets.RULES))}),
p AS (SELECT doc_id, kind, ord, i, length(m[i]) AS n, length(v[i]) AS nv,
             sum(length(pieces[i]) + length(m[i])) OVER (PARTITION BY doc_id, ord ORDER BY i) AS e FROM k),
f AS (SELECT doc_id, kind, ord, e - n AS s, kind || ':' || CAST(e - n AS BIGINT) || ':' || CAST(e AS BIGINT) AS x
      FROM p WHERE CASE kind {" ".join(f"WHEN '{r.kind}' THEN nv >= {r.least}" for r in secrets.RULES if r.least)} ELSE TRUE END),
a AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secrets.BASE_KINDS)},
             string_agg(x, ',' ORDER BY s, ord) FILTER (WHERE ord < {len(secrets.BASE_KINDS)}) AS base, string_agg(x, ',' ORDER BY s, ord) AS spans
      FROM f GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in secrets.BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""

_M = list(quality.MEASURES)
_CELLS = 1 << quality.DIGITS


def _cell(rate: str) -> str:
    dropped = f"greatest(length(bin({rate})) - {quality.DIGITS}, 0)"
    return f"CAST({dropped} * {_CELLS} + ({rate} >> {dropped}) AS INTEGER)"


def _fence(name: str, keys: str) -> str:
    group = f"GROUP BY {keys}, measure, bucket" if keys else "GROUP BY measure, bucket"
    part = f"{keys}, measure" if keys else "measure"
    floor = lambda b: f"(CAST({b} % {_CELLS} AS BIGINT) << ({b} // {_CELLS}))"
    return f"""
{name} AS (SELECT {part}, size, {floor("high")} + {quality.SPREAD} * ({floor("high")} - {floor("mid")}) AS fence FROM (
      SELECT {part}, max(size) AS size, min(bucket) FILTER (WHERE 10 * upto >= 5 * size) AS mid, min(bucket) FILTER (WHERE 10 * upto >= 9 * size) AS high
      FROM (SELECT {part}, bucket, sum(n) OVER (PARTITION BY {part} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {part}) AS size
            FROM (SELECT {part}, bucket, count(*) AS n FROM u {group})) GROUP BY {part}))"""


def _rate(name: str) -> str:
    a, b = quality.MEASURES[name]
    return f"CASE WHEN {b} > 0 THEN CAST({quality.MILLION} * {a} // {b} AS BIGINT) ELSE 0 END AS {name}"


OP10 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT g.doc_id, unnest(range(g.i, g.i + 3)) AS p FROM g
        JOIN (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1) USING (doc_id, gram)) GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS blanks, length(t) AS chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_capitals,
             CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
q AS (SELECT *, CAST(chars - blanks AS BIGINT) AS word_chars FROM m),
s AS (SELECT *, {", ".join(map(_rate, _M))} FROM q),
u AS ({" UNION ALL ".join(f"SELECT coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, '{x}' AS measure, {_cell(x)} AS bucket FROM s" for x in _M)}),
{_fence("fa", "lang, source")}, {_fence("fb", "lang")}, {_fence("fc", "")},
th AS (SELECT fa.lang, fa.source, {", ".join(f"max(CASE WHEN measure = '{x}' THEN f END) AS t_{x}" for x in _M)}
       FROM (SELECT fa.lang, fa.source, fa.measure, CASE WHEN fa.size >= {quality.LEAST} THEN fa.fence WHEN fb.size >= {quality.LEAST} THEN fb.fence ELSE fc.fence END AS f
             FROM fa JOIN fb ON fa.lang = fb.lang AND fa.measure = fb.measure JOIN fc ON fa.measure = fc.measure) fa GROUP BY fa.lang, fa.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND {" AND ".join(f"{quality.MILLION} * ({a} - {quality.ALLOW}) <= t_{x} * {b}" for x, (a, b) in quality.MEASURES.items())} AS kept
FROM s JOIN th ON coalesce(s.lang, chr(0)) = th.lang AND coalesce(s.source, chr(0)) = th.source
"""

ORACLES = {"op1_decontaminate": OP1, "op5_mix": OP5, "op8_secrets": OP8, "op10_quality": OP10}
