"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from tilewright.llm import licenses


def license_sql(templates, stride):
    """SQL of op1's rows: words numbered, each put in its blocks, templates as word lists."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows, need = [], []
    for k, t in enumerate(templates):
        ws = [w.decode() for w in licenses.words(t.text)]
        need.append(f"({k}, {quote(t.label)}, {str(t.phrase).lower()}, {len(set(ws))}, {math.ceil(t.threshold * len(set(ws)) - 1e-9)}, {quote(' '.join(ws))}, {len(ws)})")
        rows += [f"({k}, {quote(w)})" for w in sorted(set(ws))]
    return rf"""
WITH need(k, label, phrase, size, least, said, len) AS (VALUES {", ".join(need)}), vocabulary(k, w) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc_id, ws[i + 1] AS w, i FROM d, unnest(range(len(ws))) AS u(i)),
b AS (SELECT doc_id, w, i // {stride} AS block FROM w WHERE w IN (SELECT w FROM vocabulary) UNION SELECT doc_id, w, i // {stride} - 1 FROM w WHERE i >= {stride} AND w IN (SELECT w FROM vocabulary)),
met AS (SELECT doc_id, block, k, count(DISTINCT b.w) AS n FROM b JOIN vocabulary v ON b.w = v.w GROUP BY ALL),
blocks AS (SELECT doc_id, label, n / size AS containment FROM met JOIN need USING (k) WHERE n >= least AND NOT phrase),
places AS (SELECT doc_id, label, i FROM need JOIN w ON phrase AND w.w = split_part(said, ' ', 1) JOIN d USING (doc_id) WHERE array_to_string(ws[i + 1:i + len], ' ') = said),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, containment AS score FROM blocks UNION ALL SELECT doc_id, label, 1.0 FROM places) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op1_licenses": license_sql(licenses.TEMPLATES, licenses.STRIDE),
    "op2_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
""",
    "op5_url_filter": r"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
g AS (
  SELECT *, concat_ws(',',
    CASE WHEN regexp_matches(host, '(?s)^.*cheap-pills.*$') THEN '*cheap-pills*' END,
    CASE WHEN regexp_matches(host, '(?s)^.*free-bets.*$') THEN '*free-bets*' END,
    CASE WHEN regexp_matches(host, '(?s)^.*spam-farm.*$') THEN '*spam-farm*' END,
    CASE WHEN regexp_matches(host, '(?s)^ads-.*$') THEN 'ads-*' END,
    CASE WHEN regexp_matches(host, '(?s)^ads\..*$') THEN 'ads.*' END,
    CASE WHEN regexp_matches(host, '(?s)^.*\.ads-.*$') THEN '*.ads-*' END,
    CASE WHEN regexp_matches(host, '(?s)^.*\.ads\..*$') THEN '*.ads.*' END,
    CASE WHEN regexp_matches(host, '(?s)^.*-casino\..*$') THEN '*-casino.*' END,
    CASE WHEN regexp_matches(host, '(?s)^.*\.doubleclick\.net$') THEN '*.doubleclick.net' END) AS globs,
  CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR globs <> '' THEN 'block' ELSE 'allow' END AS verdict, globs
FROM g
""",
    "op8_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(regexp_replace(role, '[\\<>]', '__', 'g')) + length(regexp_replace(text, '[\\<>]', '__', 'g')) + 15) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS rewrites
FROM t GROUP BY conv_id
""",
    "op4_mixing": r"""
WITH RECURSIVE z AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY 1),
o AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1.0::DOUBLE AS weight FROM s),
f AS (SELECT 0 AS step, (SELECT sum(source_size) / sum(weight) FROM o)::DOUBLE AS level
  UNION ALL SELECT step + 1, (SELECT (sum(source_size) - sum(CASE WHEN weight * level > 3 * source_size THEN 3 * source_size ELSE 0 END)) / sum(CASE WHEN weight * level > 3 * source_size THEN 0 ELSE weight END) FROM o) FROM f WHERE step < 60),
t AS (SELECT source, source_size, CASE WHEN weight * level > 3 * source_size THEN 3.0 * source_size ELSE weight * level END AS target FROM o, (SELECT level FROM f ORDER BY step DESC LIMIT 1)),
n AS (SELECT CAST(round(sum(target) / 16) AS BIGINT) AS seats FROM t),
q AS (SELECT source, target / (2 * i + 1) AS quotient, i FROM t, unnest(range(CAST(ceil(target / 16) AS BIGINT) + 40)) AS u(i) WHERE target > 0),
won AS (SELECT source, count(*) AS won FROM (SELECT source FROM q ORDER BY quotient DESC, source, i LIMIT (SELECT seats FROM n)) GROUP BY 1),
k AS (SELECT z.*, md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, greatest(CAST(ceil(source_size / 200000.0) AS BIGINT), 1) AS shards, source_size, target, coalesce(won, 0) AS won FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON z.source IS NOT DISTINCT FROM won.source),
h AS (SELECT *, CAST('0x' || key[1:8] AS BIGINT) % shards AS shard FROM k),
g AS (SELECT source, shard, sum(size)::BIGINT AS tokens, any_value(won) AS won FROM h GROUP BY ALL),
r AS (SELECT source, shard, won, row_number() OVER (PARTITION BY source ORDER BY tokens / (2 * i + 1) DESC, shard, i) AS nth FROM g, unnest(range(CAST(won AS BIGINT) + 1)) AS u(i) WHERE tokens > 0),
p AS (SELECT source, shard, count(*) AS quota FROM r WHERE nth <= won GROUP BY ALL),
l AS (SELECT h.*, g.tokens, coalesce(p.quota, 0) AS quota, sum(size) OVER (PARTITION BY h.source, h.shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM h JOIN g ON h.source IS NOT DISTINCT FROM g.source AND h.shard = g.shard LEFT JOIN p ON h.source IS NOT DISTINCT FROM p.source AND h.shard = p.shard),
e AS (SELECT *, CAST(ceil(tokens / 16.0) AS BIGINT) AS blocks FROM l),
c AS (SELECT *, CASE WHEN blocks > 0 THEN least(quota // blocks, 3) ELSE 0 END AS rounds FROM e)
SELECT doc_id, size, source_size, target, CAST(size * rounds + greatest(least(upto, CASE WHEN rounds < 3 THEN (quota - rounds * blocks) * 16 ELSE 0 END) - (upto - size), 0) AS BIGINT) AS taken FROM c
""",
    "op10_pii": r"""
WITH k(kind, rank, pattern, score, words) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.9, 'mail|contact|write|kontakt|correo|courriel'),
  ('ip', 1, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)', 0.6, 'ip|host|server|address|adresse'),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+', 0.8, 'card|visa|credit|karte|carte|tarjeta|payment'),
  ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]', 0.7, 'call|phone|tel|fax|mobile|telefon|appel'),
  ('iban', 4, '\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b', 0.9, 'iban|account|konto|compte|cuenta|bank'),
  ('ssn', 5, '\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b', 0.3, 'ssn|social security')),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
f AS (SELECT rid, t, k.*, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gaps FROM d, k),
x AS (SELECT rid, t, kind, rank, score, words, ms[i + 1] AS m, CAST(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i], lambda g: length(g))), 0) AS BIGINT) AS start FROM f, unnest(range(len(ms))) AS u(i)),
e AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS tight, regexp_replace(m, ' [A-Z0-9]*$', '') AS shorter, substr(t, greatest(start - 40, 0) + 1, least(start, 40)) AS near FROM x),
c AS (SELECT *, list_reduce(list_transform(string_split(tight[5:] || tight[1:4], ''), lambda a: ascii(a)), lambda a, b: CASE WHEN b < 58 THEN (a * 10 + b - 48) % 97 ELSE (a * 100 + b - 55) % 97 END, 0) AS rest,
  list_reduce(list_transform(string_split(replace(shorter, ' ', '')[5:] || replace(shorter, ' ', '')[1:4], ''), lambda a: ascii(a)), lambda a, b: CASE WHEN b < 58 THEN (a * 10 + b - 48) % 97 ELSE (a * 100 + b - 55) % 97 END, 0) AS rest2 FROM e),
g AS (SELECT rid, kind, rank, start, round(score + CASE WHEN regexp_matches(near, '(?i)(?:' || words || ')') THEN 0.1 ELSE 0 END, 2) AS sure, start + length(CASE kind WHEN 'email' THEN m WHEN 'ssn' THEN m
    WHEN 'ip' THEN CASE WHEN list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 4 AND CAST(right(p, 3) AS INTEGER) <= 255)) THEN m END
    WHEN 'phone' THEN CASE WHEN length(digits) BETWEEN 9 AND 15 THEN m END
    WHEN 'card' THEN CASE WHEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substr(reverse(digits), j + 1, 1) AS BIGINT)
      ELSE (CAST(substr(reverse(digits), j + 1, 1) AS BIGINT) * 2) % 10 + CAST(substr(reverse(digits), j + 1, 1) AS BIGINT) // 5 END)) % 10 = 0 THEN m END
    WHEN 'iban' THEN CASE WHEN rest = 1 THEN m WHEN shorter <> m AND length(replace(shorter, ' ', '')) >= 15 AND rest2 = 1 THEN shorter END END) AS stop FROM c),
s AS (SELECT *, kind || ':' || start || ':' || stop AS said FROM g WHERE stop IS NOT NULL AND (rank < 4 OR sure >= 0.4)),
a AS (SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(said, ',' ORDER BY start, rank) FILTER (rank < 4) AS base, string_agg(said, ',' ORDER BY start, rank) AS spans, max(sure) AS top_score FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(top_score, 0) AS DOUBLE) AS top_score FROM d LEFT JOIN a USING (rid)
""",
}
