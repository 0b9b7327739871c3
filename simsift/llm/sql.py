"""SQL twins of the queries, for another engine on the same tables."""

from __future__ import annotations

HOST_RULES = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN lines USING (doc_id)),
r AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
         100 * n_symbols > 10 * n_words AS symbols FROM m),
h AS (
  SELECT source AS host, count(*) AS n, unnest(['short', 'repeats', 'symbols']) AS rule,
         unnest([count(*) FILTER (short), count(*) FILTER (repeats), count(*) FILTER (symbols)]) AS k
  FROM r WHERE source IS NOT NULL GROUP BY source),
p AS (
  SELECT rule, sum(k) / sum(n) AS mean, sum(n) AS total, count(*) AS hosts, sum(k * k / n) / sum(n) AS sq
  FROM h GROUP BY rule),
q AS (
  SELECT rule, mean, mean * (1 - mean) AS within,
         sq - mean * mean - mean * (1 - mean) * (hosts - 1) / total AS spread FROM p),
prior AS (
  SELECT rule, mean,
         least(greatest(CASE WHEN spread > 0 THEN within / spread - 1 ELSE 1e6 END, 1), 1e6) AS strength
  FROM q),
bad AS (
  SELECT DISTINCT host FROM h JOIN prior USING (rule)
  WHERE (k + mean * strength) / (n + strength) > 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       short OR repeats AS base_failed, NOT (short OR repeats) AND bad.host IS NULL AS kept
FROM r LEFT JOIN bad ON r.source = bad.host
"""

DECONTAMINATION = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM benchmark),
i AS (
  SELECT DISTINCT item_id, len(ws) AS n_words, least(len(ws), 5) AS w,
         array_to_string(ws[k:k + least(len(ws), 5) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS k FROM b WHERE len(ws) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, w, array_to_string(ws[k:k + w - 1], ' ') AS g
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS k
        FROM d, (SELECT DISTINCT w FROM i) WHERE len(ws) >= w)),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, n_shingles::INT AS n_shingles, count(*)::INT AS n_found
FROM g JOIN i USING (w, g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING count(*) * 100 >= n_shingles * 75
"""

_DRAWN = "('0x' || substr(md5({}), 1, 7))::INT"

URL_LISTS = rf"""
WITH c AS (
  SELECT page_id, nullif(lower(regexp_replace(regexp_replace(
           regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*)://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$|\.$', '')), '') AS host,
         regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*)://[^/?#]*/([^/?#]*)', 1) AS segment,
         DATE '2024-01-01' + {_DRAWN.format("'fetched' || page_id")} % 366 AS fetched_on
  FROM pages),
s AS (
  SELECT DISTINCT host, segment, {_DRAWN.format("host || '/' || segment")} % 3 AS draw FROM c WHERE host IS NOT NULL),
p AS (
  SELECT DISTINCT CASE WHEN draw = 0 THEN host WHEN draw = 1 AND segment <> '' THEN host || '/' || segment
                       WHEN len(string_split(host, '.')) > 2 THEN regexp_replace(host, '^[^.]+\.', '')
                       ELSE host END AS pattern FROM s),
e AS (
  SELECT pattern, category, day, r % 2 = 0 AS listed, pattern || ':' || r AS entry_id
  FROM (SELECT pattern, r, ['ads', 'malware', 'adult'][{_DRAWN.format("'kind' || pattern")} % 3 + 1] AS category,
               DATE '2024-01-01' + {_DRAWN.format("'day' || pattern || ':' || r")} % 366 AS day
        FROM p, range(4) AS x(r) WHERE {_DRAWN.format("'listed' || pattern")} % 5 = 0)),
k AS (
  SELECT DISTINCT page_id, fetched_on, unnest(
    list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))
    || CASE WHEN segment <> '' THEN [host || '/' || segment] ELSE [] END) AS key
  FROM c WHERE host IS NOT NULL),
a AS (
  SELECT page_id, category, arg_max(listed, (day, entry_id)) AS listed
  FROM k JOIN e ON key = pattern AND day <= fetched_on GROUP BY page_id, key, category),
v AS (
  SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n
  FROM a WHERE listed GROUP BY page_id)
SELECT page_id, fetched_on::DATE AS fetched_on, host, n IS NOT NULL AS blocked,
       coalesce(categories, '') AS categories, coalesce(n, 0) AS n_entries
FROM c LEFT JOIN v USING (page_id)
"""

TOOL_CALLS = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, 'c' || turn AS here,
         len(string_split(coalesce(text, ''), ' ')) AS n, {_DRAWN.format("conv_id || ':' || turn")} AS draw
  FROM conversations WHERE role = 'assistant'),
calls AS (
  SELECT conv_id, here || suffix AS call_id,
         CASE WHEN suffix = 'b' THEN here
              WHEN draw % 2 = 0 THEN 'c' || (turn + CASE WHEN draw % 31 = 0 THEN 2 ELSE -2 END) END AS needs,
         CASE WHEN draw % 5 IN (1, 3) THEN 'weather' ELSE 'search' END AS tool,
         ['', 'missing:days,unknown:zip', 'json', '', 'type:limit'][[1, 4, 5, 2, 3][draw % 5 + 1]] AS errors,
         CASE draw % 5
           WHEN 0 THEN '{{"limit":' || n || ',"query":' || to_json(text) || '}}'
           WHEN 1 THEN '{{"city":' || to_json(text) || ',"days":' || n || '}}'
           WHEN 2 THEN '{{"limit":"' || n || '","query":' || to_json(text) || '}}'
           WHEN 3 THEN '{{"city":' || to_json(text) || ',"zip":' || n || '}}' ELSE 'null' END AS arguments
  FROM t, (VALUES (''), ('b')) AS x(suffix) WHERE suffix = '' OR draw % 3 = 0),
answers AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role <> 'assistant' AND turn > 0 GROUP BY ALL),
edges AS (
  SELECT DISTINCT a.conv_id, a.call_id, a.needs FROM calls a
  WHERE EXISTS (SELECT 1 FROM calls b WHERE b.conv_id = a.conv_id AND b.call_id = a.needs)),
lev AS (
  SELECT DISTINCT conv_id, call_id, 0 AS level FROM calls ANTI JOIN edges USING (conv_id, call_id)
  UNION ALL
  SELECT e.conv_id, e.call_id, level + 1 FROM lev JOIN edges e ON e.conv_id = lev.conv_id AND e.needs = lev.call_id)
SELECT conv_id, call_id, tool, level, coalesce(n_results, 0) AS n_results, errors,
       CASE WHEN errors <> '' THEN 'invalid' WHEN n_results IS NULL THEN 'unlinked'
            WHEN level IS NULL THEN 'cycle' ELSE 'ok' END AS status,
       '{{"arguments":' || arguments || ',"id":"' || call_id || '","name":"' || tool || '","result":'
         || coalesce(to_json(content), 'null') || '}}' AS record
FROM calls LEFT JOIN answers USING (conv_id, call_id) LEFT JOIN lev USING (conv_id, call_id)
"""
