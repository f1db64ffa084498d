"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lamina.llm.decontaminate import op7_decontamination
from lamina.llm.html_text import op6_html_text
from lamina.llm.jaccard_join import op10_jaccard_join
from lamina.llm.langid import op2_langid
from lamina.llm.mixing import op9_mixing
from lamina.llm.pii import op8_pii
from lamina.llm.quality import op3_quality
from lamina.llm.token_counts import op1_token_counts
from lamina.llm.toxicity import op5_toxicity
from lamina.llm.warc import op4_warc

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_langid": op2_langid,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_html_text": op6_html_text,
    "op7_decontamination": op7_decontamination,
    "op8_pii": op8_pii,
    "op9_mixing": op9_mixing,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLES: dict[str, str] = {
    "op4_warc": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
t AS (SELECT sha, max(page_id) AS top FROM p GROUP BY sha)
SELECT p.page_id, p.url, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (CAST('0x' || substr(p.sha, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) % 32 + 1, 1)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN p.page_id = t.top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> t.top THEN t.top END AS refers_to, true AS intact
FROM p JOIN t ON p.sha = t.sha""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
}
