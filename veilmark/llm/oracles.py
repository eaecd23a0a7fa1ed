"""DuckDB SQL for the queries that SQL can express."""

_ALNUM = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Exact containment of every item's shingles in every document.
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_ALNUM.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format('text')} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 5) AS k, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda p: array_to_string(w[p:p + 4], ' ')))) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY ALL),
s AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS g FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM s JOIN i USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item
"""

#: Rules in the order of their precedence: the longest that fits wins.
URL_FILTER = r"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*', 0, 's') AS raw FROM rest),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(r, length(raw) + 1), '^[^?#]*', 0, 's') AS path FROM h),
rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n
  FROM u LEFT JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""

ORACLES = {"op6_decontamination": DECONTAMINATION, "op5_url_filter": URL_FILTER}
