"""DuckDB SQL for the WARC records and for the similarity join, written from their definition."""

from __future__ import annotations

_GROUPS = " || ".join(f"to_base(('0x' || h[{5 * k + 1}:{5 * k + 5}])::BIGINT, 32, 4)" for k in range(8))

WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, translate({_GROUPS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS source FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = source THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> source THEN source END AS refers_to FROM d"""

#: All pairs of sets that share a shingle are counted; groups are closed by recursion.
JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS h, count(*) AS n FROM g GROUP BY doc_id),
r AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n FROM s GROUP BY h),
rg AS (SELECT rep, g FROM g JOIN r ON g.doc_id = r.rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS c FROM rg a JOIN rg b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
one AS (SELECT x, y FROM p JOIN r a ON a.rep = x JOIN r b ON b.rep = y WHERE 10 * c >= 8 * (a.n + b.n - c)),
link AS (SELECT x, y FROM one UNION ALL SELECT y, x FROM one),
reach AS (SELECT rep AS x, rep AS y FROM r UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
class AS (SELECT x AS rep, min(y) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x AS rep, count(*) AS n_links FROM link GROUP BY x)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(r.rep, d.doc_id) AS set_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN r ON r.h = s.h LEFT JOIN class c ON c.rep = r.rep LEFT JOIN degree e ON e.rep = r.rep"""
