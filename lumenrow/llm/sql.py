"""DuckDB SQL for the corpus queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

_OP8 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(nullif(trim(regexp_replace(url, '\\s+', ' ', 'g')), ''), 'about:blank') AS target_uri FROM pages),
    g AS (SELECT b, max(page_id) AS m FROM p WHERE octet_length(b) >= 1000 GROUP BY b HAVING count(*) > 1)
    SELECT page_id, CAST(octet_length(p.b) AS BIGINT) AS payload_bytes, sha1(p.b) AS payload_digest, CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to, target_uri FROM p LEFT JOIN g ON p.b = g.b"""

ORACLE_SQL: dict[str, str] = {"op8_warc": _OP8}
