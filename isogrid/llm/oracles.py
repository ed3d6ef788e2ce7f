"""SQL for operators whose results DuckDB can compute by plainer means."""

from __future__ import annotations

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
t AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(x, (10 * (k // 8) + 1)::BIGINT, 10))::BIGINT >> (35 - 5 * (k % 8))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to FROM t
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS p FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
x AS (SELECT r, n, i, array_to_string(w[i + 1 : i + n], ' ') AS p FROM (SELECT r, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT r, i, n, item FROM x JOIN p USING (p, n)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
