"""Query of the URL filter over all pages.

The table has no fetch times and no lists. A page's fetch day follows from its
id; the events of two lists follow from its hosts and leading path parts by a
hash, so both grow with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pelage.llm import url_lists
from pelage.llm.registry import query, table

c = F.col

_HOST = "regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '[.]?(:[0-9]*)?$', '')"
_PLACE = "regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*(/[^/?#]+)', 1)"
# Days after the first day; every third host is listed, every other of them is taken off later.
EVENTS = f"""
SELECT 'hosts' AS list, host AS pattern, 'add' AS action, 10 + CAST(day % 40 AS INT) AS since
FROM (SELECT DISTINCT {_HOST} AS host, CAST(length({_HOST}) * 7 + ascii(substr({_HOST}, 3, 1)) AS INT) AS day FROM {{pages}}) WHERE host <> '' AND day % 3 = 0
UNION ALL
SELECT 'hosts' AS list, host AS pattern, 'remove' AS action, 60 + CAST(day % 30 AS INT) AS since
FROM (SELECT DISTINCT {_HOST} AS host, CAST(length({_HOST}) * 7 + ascii(substr({_HOST}, 3, 1)) AS INT) AS day FROM {{pages}}) WHERE host <> '' AND day % 2 = 0
UNION ALL
SELECT 'domains' AS list, regexp_replace(host, '^[^.]*[.]', '') AS pattern, 'add' AS action, 20 AS since
FROM (SELECT DISTINCT {_HOST} AS host FROM {{pages}}) WHERE host LIKE '%.%.%.%' AND length(host) % 2 = 0
UNION ALL
SELECT 'paths' AS list, concat(host, place) AS pattern, 'add' AS action, 30 + CAST(length(host) % 50 AS INT) AS since
FROM (SELECT DISTINCT {_HOST} AS host, {_PLACE} AS place FROM {{pages}}) WHERE host <> '' AND place <> '' AND length(host) % 5 = 1
"""


def events(pages):
    return pages.sparkSession.sql(EVENTS, pages=pages)


SQL = f"""
WITH events AS ({EVENTS.format(pages="pages")}),
days AS (SELECT list, lower(pattern) AS pattern, since, max(CASE WHEN action = 'remove' THEN 1 ELSE 0 END) AS gone
  FROM events GROUP BY ALL),
turns AS (SELECT *, lag(gone) OVER (PARTITION BY list, pattern ORDER BY since) AS before FROM days),
spans AS (SELECT list, pattern, gone, since AS valid_from, lead(since) OVER (PARTITION BY list, pattern ORDER BY since) AS valid_to
  FROM turns WHERE before IS NULL AND gone = 0 OR before <> gone),
entries AS (SELECT * FROM spans WHERE gone = 0),
captures AS (SELECT page_id, CAST(page_id % 100 AS INT) AS fetched, {_HOST} AS host, string_split({_HOST}, '.') AS labels,
  list_filter(string_split(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'), lambda p: p <> '') AS parts FROM pages),
keys AS (
  SELECT page_id, fetched, array_to_string(labels[i:], '.') AS pattern
    FROM captures, unnest(range(1, greatest(len(labels), 2))) AS t(i) WHERE host <> ''
  UNION
  SELECT page_id, fetched, host || '/' || array_to_string(parts[:i], '/') AS pattern
    FROM captures, unnest(range(1, len(parts) + 1)) AS t(i) WHERE host <> ''),
hits AS (SELECT k.page_id, e.list, k.pattern FROM keys k JOIN entries e ON k.pattern = e.pattern
  AND e.valid_from <= k.fetched AND (e.valid_to IS NULL OR k.fetched < e.valid_to)),
active AS (SELECT page_id, count(*) AS n_active, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists,
  arg_min(pattern, struct_pack(a := -length(pattern), b := pattern)) AS rule FROM hits GROUP BY page_id)
SELECT c.page_id, CASE WHEN c.host <> '' THEN c.host END AS host, coalesce(n_active, 0) AS n_active,
  coalesce(lists, '') AS lists, rule, coalesce(n_active, 0) > 0 AS blocked
FROM captures c LEFT JOIN active a ON a.page_id = c.page_id
"""


@query("op2_url_lists", SQL)
def op2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", (c("page_id") % 100).cast("int").alias("fetched"))
    found = url_lists.evaluate(captures, url_lists.validity(events(pages)), "page_id", "url", "fetched")
    return found.select(c("id").alias("page_id"), "host", "n_active", "lists", "rule",
                        (c("n_active") > 0).alias("blocked"))
