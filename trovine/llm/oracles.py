"""SQL for the queries whose result SQL can say. Words are runs of other bytes than space and tab to carriage return."""

from __future__ import annotations

from .quality_rules import CUTOFFS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5) x),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) x WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) x GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
base AS (SELECT t.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(cov.n, 0) > 20 * len(w) AS base_failed
  FROM t JOIN ln ON ln.doc_id = t.doc_id LEFT JOIN cov ON cov.doc_id = t.doc_id),
ratio AS (SELECT doc_id, stratum, base_failed, 'symbols' AS rule, n_symbols / greatest(n_words, 1)::DOUBLE AS r FROM base UNION ALL
  SELECT doc_id, stratum, base_failed, 'dup_lines', n_dup_lines / greatest(n_lines, 1)::DOUBLE FROM base UNION ALL
  SELECT doc_id, stratum, base_failed, 'repeats', n_repeat_words / greatest(n_words, 1)::DOUBLE FROM base),
known AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
own AS (SELECT doc_id, stratum, rule, max(r) AS r FROM ratio WHERE NOT base_failed GROUP BY ALL),
cell AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND r >= cutoff) AS k, count(*) FILTER (quality = 0 AND r >= cutoff) AS hits
  FROM own JOIN known USING (doc_id), (SELECT unnest([{", ".join(map(str, CUTOFFS))}])::DOUBLE AS cutoff) c GROUP BY ALL),
p AS (SELECT *, 3 * (SELECT count(DISTINCT stratum) FROM cell) AS tests, CASE WHEN k >= n * (0.05::DOUBLE / 3) THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda j:
  exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05::DOUBLE / 3) + (n - j) * ln(1 - 0.05::DOUBLE / 3)))) END AS p FROM cell),
cut AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY hits - 10 * k DESC, cutoff DESC) AS o FROM p WHERE p <= 0.05::DOUBLE / tests AND hits - 10 * k > 0) x WHERE o = 1),
bad AS (SELECT DISTINCT doc_id FROM ratio JOIN cut USING (stratum, rule) WHERE r >= cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM base
"""

#: Counts from the rows. The text of a message with calls has no SQL form (see the tests): it stands as its plain text.
CHATS = r"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
v AS (SELECT *, CASE WHEN json_valid(text) AND (role = 'assistant' AND contains(text, '"tool_calls"') OR role = 'tool') THEN text::JSON END AS j FROM m),
c0 AS (SELECT conv_id, turn, md5(text) AS mid, unnest(from_json(j->'$.tool_calls', '["JSON"]')) AS c, unnest(range(json_array_length(j->'$.tool_calls')::BIGINT)) AS idx
  FROM v WHERE role = 'assistant' AND json_type(j->'$.tool_calls') = 'ARRAY'),
c AS (SELECT conv_id, turn, mid, idx, c->>'$.id' AS id, coalesce(c->>'$.name', c->>'$.function.name') AS name, coalesce(c->>'$.arguments', c->>'$.function.arguments') AS given,
  CASE WHEN json_type(c->'$.depends_on') = 'ARRAY' THEN from_json(c->'$.depends_on', '["VARCHAR"]') ELSE [] END AS deps FROM c0),
a AS (SELECT *, CASE WHEN json_valid(given) AND json_type(CASE WHEN json_valid(given) THEN given::JSON END) = 'OBJECT' THEN given::JSON END AS args FROM c),
res AS (SELECT DISTINCT conv_id, turn, j->>'$.tool_call_id' AS id FROM v WHERE role = 'tool' AND j->>'$.tool_call_id' IS NOT NULL),
ev AS (SELECT conv_id, id, turn, max(k) AS called, max(r) AS answered FROM (SELECT conv_id, id, turn, 1 AS k, 0 AS r FROM c WHERE id IS NOT NULL UNION ALL SELECT conv_id, id, turn, 0, 1 FROM res) x GROUP BY ALL),
nx AS (SELECT *, lead(1 - called) OVER (PARTITION BY conv_id, id ORDER BY turn) AS free FROM ev),
linked AS (SELECT conv_id, turn, count(*) AS n_linked FROM nx WHERE called = 1 AND (answered = 1 OR free = 1) GROUP BY ALL),
dep AS (SELECT DISTINCT conv_id, turn, mid, idx, unnest(deps) AS d FROM c),
edge AS (SELECT DISTINCT dep.*, c.idx AS on_ FROM dep JOIN c ON c.conv_id IS NOT DISTINCT FROM dep.conv_id AND c.turn = dep.turn AND c.mid = dep.mid AND c.id = dep.d),
reach AS (SELECT conv_id, turn, mid, idx, on_ FROM edge UNION SELECT r.conv_id, r.turn, r.mid, r.idx, e.on_ FROM reach r JOIN edge e
  ON e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.turn = r.turn AND e.mid = r.mid AND e.idx = r.on_),
ring AS (SELECT DISTINCT conv_id, turn, mid, idx FROM reach WHERE idx = on_),
cyclic AS (SELECT DISTINCT r.conv_id, r.turn, r.mid, r.idx FROM reach r JOIN ring ON ring.conv_id IS NOT DISTINCT FROM r.conv_id AND ring.turn = r.turn AND ring.mid = r.mid AND ring.idx = r.on_),
late AS (SELECT DISTINCT conv_id, turn, mid, idx FROM dep ANTI JOIN c ON c.conv_id IS NOT DISTINCT FROM dep.conv_id AND c.id = dep.d AND (c.turn < dep.turn OR c.turn = dep.turn)),
tool(name, param, type, required) AS (VALUES ('search', 'query', 'string', true), ('search', 'limit', 'integer', false), ('calculate', 'expression', 'string', true)),
field AS (SELECT conv_id, turn, mid, idx, name, unnest(json_keys(args)) AS param, args FROM a WHERE args IS NOT NULL),
typed AS (SELECT * EXCLUDE (args), CASE json_type(json_extract(args, '$."' || param || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' ELSE 'other' END AS kind FROM field),
bad AS (SELECT conv_id, turn, mid, idx FROM a WHERE args IS NULL OR name IS NULL OR name NOT IN (SELECT name FROM tool)
  UNION SELECT conv_id, turn, mid, idx FROM typed f LEFT JOIN tool t ON t.name = f.name AND t.param = f.param WHERE f.name IN (SELECT name FROM tool) AND (t.type IS NULL OR t.type <> kind)
  UNION SELECT conv_id, turn, mid, idx FROM a JOIN tool t ON t.name = a.name AND t.required WHERE args IS NULL OR NOT list_contains(json_keys(args), t.param)),
per AS (SELECT conv_id, turn // 256 - CASE WHEN turn < 0 THEN 1 ELSE 0 END AS record, sum(n1) AS n_calls, sum(n2) AS n_linked, sum(n3) AS n_invalid, sum(n4) AS n_cyclic, sum(n5) AS n_unmet FROM (
  SELECT conv_id, turn, 1 AS n1, 0 AS n2, 0 AS n3, 0 AS n4, 0 AS n5 FROM c UNION ALL SELECT conv_id, turn, 0, n_linked, 0, 0, 0 FROM linked UNION ALL SELECT conv_id, turn, 0, 0, 1, 0, 0 FROM bad
  UNION ALL SELECT conv_id, turn, 0, 0, 0, 1, 0 FROM cyclic UNION ALL SELECT conv_id, turn, 0, 0, 0, 0, 1 FROM late) x GROUP BY ALL),
shown AS (SELECT conv_id, turn, turn // 256 - CASE WHEN turn < 0 THEN 1 ELSE 0 END AS record, role, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS message FROM m),
msg AS (SELECT conv_id, record, count(*) AS n_messages, '[' || string_agg(message, ',' ORDER BY turn, role, message) || ']' AS json FROM shown GROUP BY ALL)
SELECT msg.conv_id, msg.record, 0::BIGINT AS piece, n_messages, coalesce(n_calls, 0)::BIGINT AS n_calls, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(n_invalid, 0)::BIGINT AS n_invalid,
  coalesce(n_cyclic, 0)::BIGINT AS n_cyclic, coalesce(n_unmet, 0)::BIGINT AS n_unmet, json FROM msg LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM msg.conv_id AND per.record = msg.record
"""

NEAR = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT e.b, reach.m FROM reach JOIN e ON e.a = reach.d WHERE reach.m < e.b),
least_ AS (SELECT d, min(m) AS m FROM reach GROUP BY d)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m AS component_id, t.doc_id = m AS kept FROM t LEFT JOIN n ON n.doc_id = t.doc_id JOIN least_ ON d = t.doc_id
"""

REPEATS = rf"""
WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20) x),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS o FROM win) x WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""

#: The pages' own markup: an article of headings, paragraphs, bold text and line breaks. A reference may lack its semicolon.
PAGES = r"""
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '</?b>', '', 'g'), '</?(p|h[1-6]|br)>', ' ', 'g'),
    '&quot;?', '"', 'g'), '&#x27;', ''''), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM pages) x
"""

SQL = {"op1_quality_rules": QUALITY, "op2_chat_format": CHATS, "op4_near_dedup": NEAR, "op7_substring_dedup": REPEATS, "op10_html_extract": PAGES}
