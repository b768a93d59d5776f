"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenrank.llm.decontaminate import op1_decontaminate
from lumenrank.llm.embeddings import op7_embeddings
from lumenrank.llm.layout import op5_html
from lumenrank.llm.mixing import op8_mixing
from lumenrank.llm.pii import op9_pii
from lumenrank.llm.simhash import op3_simhash
from lumenrank.llm.substring import op6_substring
from lumenrank.llm.tokens import op10_tokens
from lumenrank.llm.toxicity import op2_toxicity
from lumenrank.llm.warc import op4_warc

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_toxicity": op2_toxicity,
    "op3_simhash_near_dedup": op3_simhash,
    "op4_warc": op4_warc,
    "op5_html_layout": op5_html,
    "op6_substring_dedup": op6_substring,
    "op7_embedding_near_dedup": op7_embeddings,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_token_counts": op10_tokens,
}

#: SQL has no XXH64 with a seed, tiling, zstandard, trained models, HTML trees or tokenizers; those queries are tested against plain code.
SQL = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h),
d AS (SELECT page_id, h, first, sha1(h) AS x FROM p JOIN f USING (h))
SELECT page_id, strlen(h) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS j FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, j, array_to_string(ws[j + 1:j + 50], ' ') AS s FROM i),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(j, j + 50)) AS p FROM win JOIN first USING (s) WHERE doc_id > f),
words AS (SELECT doc_id, unnest(ws) AS x, unnest(range(len(ws))) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM comp LEFT JOIN n USING (vec_id)""",
}
