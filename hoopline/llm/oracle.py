"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op4_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, d AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS d FROM documents)
WINDOW g AS (PARTITION BY d)
"""

ORACLE["op9_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, i, i + 9) AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM d, lens, unnest(range(1, len(w) - n + 2)) AS s(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, dw.i, dw.n, item_id FROM dw JOIN win USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS s(p) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, url,
       CASE WHEN n < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n < 100 OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM g
"""

ORACLE["op11_imatch"] = r"""
WITH o AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
nx AS (SELECT doc_id, t, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next_t
       FROM o WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ed AS (SELECT doc_id, next_id, t, left(t, length(t) - length(t) // 4) || left(next_t, length(t) // 4) AS e FROM nx),
v AS (SELECT doc_id, 0 AS v, t AS x FROM ed UNION ALL SELECT doc_id, 1, e FROM ed),
terms AS (SELECT doc_id, v, list_distinct(regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM v),
lex AS (SELECT term FROM (SELECT unnest(w) AS term FROM terms WHERE v = 0) GROUP BY term
        HAVING count(*) >= 2 AND count(*) * 1000 >= (SELECT count(*) FROM o) AND count(*) * 10 <= (SELECT count(*) FROM o)),
each AS (SELECT doc_id, v, term, md5(term) AS h, CASE WHEN n <= 64 THEN 0 ELSE length(bin((n - 1) // 64)) END AS lev
         FROM (SELECT doc_id, v, len(w) AS n, unnest(w) AS term FROM terms)),
own AS (SELECT doc_id, v, each.term, lev, CAST('0x' || substr(h, 1, 2) AS INTEGER) % 128 AS sub, '0' || substr(h, 3, 8) AS x, lex.term IS NOT NULL AS known
        FROM each LEFT JOIN lex ON each.term = lex.term WHERE '0' || substr(h, 3, 8) < printf('%09x', CAST(1 AS BIGINT) << (32 - lev))),
chosen AS (SELECT * FROM own JOIN (SELECT doc_id, v, count(*) FILTER (known) >= 8 AS enough FROM own GROUP BY doc_id, v) USING (doc_id, v) WHERE known OR NOT enough),
sig AS (SELECT doc_id, v, lev, k, sub, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS s
        FROM chosen, range(0, 4) AS r(k) WHERE x < printf('%09x', CAST(1 AS BIGINT) << (32 - lev - k)) GROUP BY doc_id, v, lev, k, sub),
part AS (SELECT doc_id, v, lev, k, string_agg(s, '.' ORDER BY sub) AS p FROM sig GROUP BY doc_id, v, lev, k),
fp AS (SELECT doc_id, v, lev, CAST(lev AS VARCHAR) || ':' || coalesce(max(p) FILTER (k = 0), '') || ':' || coalesce(max(p) FILTER (k = 1), '') || ':' || coalesce(max(p) FILTER (k = 2), '') || ':' || coalesce(max(p) FILTER (k = 3), '') AS f
       FROM part GROUP BY doc_id, v, lev),
pairs AS (SELECT doc_id, 0 AS kind, doc_id AS x, 0 AS xv, doc_id AS y, 1 AS yv FROM ed UNION ALL SELECT doc_id, 1, doc_id, 0, next_id, 0 FROM ed),
res AS (SELECT p.doc_id, p.kind, CASE WHEN coalesce(f.f, '') = coalesce(g.f, '') THEN 1.0::DOUBLE WHEN f.f IS NULL OR g.f IS NULL OR abs(f.lev - g.lev) > 3 THEN 0.0::DOUBLE
          ELSE coalesce((SELECT count(*) FILTER (c = 2) / count(*) FROM (SELECT s, count(*) AS c FROM sig WHERE lev + k = greatest(f.lev, g.lev) AND (doc_id, v) IN ((p.x, p.xv), (p.y, p.yv)) GROUP BY s)), 0.0) END AS near
        FROM pairs p LEFT JOIN fp f ON f.doc_id = p.x AND f.v = p.xv LEFT JOIN fp g ON g.doc_id = p.y AND g.v = p.yv)
SELECT ed.doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, coalesce(f0.f, '') AS fingerprint, coalesce(f1.f, '') AS edited_fingerprint, r0.near AS near_edited, r1.near AS near_next
FROM ed LEFT JOIN fp f0 ON f0.doc_id = ed.doc_id AND f0.v = 0 LEFT JOIN fp f1 ON f1.doc_id = ed.doc_id AND f1.v = 1
JOIN res r0 ON r0.doc_id = ed.doc_id AND r0.kind = 0 JOIN res r1 ON r1.doc_id = ed.doc_id AND r1.kind = 1
"""
