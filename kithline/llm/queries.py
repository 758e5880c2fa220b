"""The subpackage's queries and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, language, licenses, near_dedup, neighbours, packing, token_output, toxicity, url_filter, warc

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_packing, licenses.op2_license_scan, toxicity.op3_toxicity, url_filter.op4_url_filter, warc.op5_warc,
        near_dedup.op6_near_dedup, neighbours.op7_neighbours, language.op8_language_id, decontaminate.op9_decontamination, token_output.op10_token_output,
    )
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"

OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) r ON r.id = d.doc_id"""

_B32 = "array_to_string(list_transform(range(0, 40, 5), lambda p: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(h, p + 1, 5) AS BIGINT) >> s) & 31)::BIGINT, 1)), '')), '')"
OP5_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, {_B32.replace('(h,', '(p.h,')} AS payload_digest,
CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON o.h = p.h"""

OP9_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda w: w <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda w: w <> '') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM i),
lens AS (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0),
h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM d, lens WHERE len(w) >= k),
n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM h JOIN g USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared / cast(n AS DOUBLE) AS containment FROM c JOIN n USING (item_id) WHERE 10 * shared >= 8 * n"""

ORACLES = {"op2_license_scan": licenses.oracle(), "op5_warc": OP5_SQL, "op6_near_dedup": OP6_SQL, "op9_decontamination": OP9_SQL}
