"""DuckDB SQL for the queries of this folder that SQL can express, other than the mixture's own."""

from loomwork.llm.urls import RULES

_WORDS = r"[^\x20\x09-\x0D]+"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT v, r FROM reach JOIN links ON u = d),
classes AS (SELECT d, min(r) AS class_id FROM reach GROUP BY d),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT d AS doc_id, class_id, coalesce(n, 0) AS n_links FROM classes LEFT JOIN counts ON d = u"""

_HOST = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_NODE = f"concat({_HOST}, '|', regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1))"
_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

URLS = f"""WITH RECURSIVE rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
mirrors AS (SELECT url, min(url) OVER (PARTITION BY article) AS to_url FROM (SELECT url, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS article
  FROM pages WHERE url IS NOT NULL) WHERE trim(article, ' ') <> ''),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
found AS (SELECT url, replace(CASE WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)
  WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1) END, '&amp;', '&') AS link FROM tags),
links AS (SELECT url AS from_url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN concat('http:', link)
  WHEN starts_with(link, '/') THEN concat('http://', {_HOST.format('url')}, link)
  ELSE concat('http://', {_HOST.format('url')}, coalesce(nullif(regexp_replace({_PATH.format('url')}, '[^/]*$', ''), ''), '/'), link) END AS to_url FROM found WHERE link <> ''
  UNION SELECT url, to_url FROM mirrors WHERE url <> to_url),
edges AS (SELECT {_NODE.format('from_url')} AS u, {_NODE.format('to_url')} AS v FROM links),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach AS (SELECT u AS node, u AS other FROM both_ways UNION SELECT node, v FROM reach JOIN both_ways ON other = u),
urls AS (SELECT DISTINCT url FROM pages UNION SELECT from_url FROM links UNION SELECT to_url FROM links),
parts AS (SELECT url, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path, {_NODE.format('url')} AS node FROM urls),
ruled AS (SELECT url, host, path, node, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, concat('.', rule_host))) AND starts_with(path, rule_path) GROUP BY url, host, path, node),
aliases AS (SELECT r.node, min(verdict) AS verdict FROM reach r JOIN ruled ON r.other = ruled.node WHERE verdict IS NOT NULL GROUP BY r.node)
SELECT page_id, host, path, rule, coalesce(r.verdict, CASE WHEN p.url IS NOT NULL THEN a.verdict END, 'allow') AS verdict,
  (p.url IS NOT NULL AND r.verdict IS NULL AND a.verdict IS NOT NULL) AS by_alias
FROM pages p JOIN ruled r ON p.url IS NOT DISTINCT FROM r.url LEFT JOIN aliases a ON a.node = r.node"""
