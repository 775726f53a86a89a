"""Queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import encode, foreign, handwritten, overlap, packing, pii, splits, syntax, terms

QUERIES = {
    f.__name__: f
    for f in (
        splits.p1_found, splits.p1_splits, splits.p1_balance, foreign.p2_found, foreign.p2_shares, handwritten.p3_found, handwritten.p3_handwritten, terms.p4_found, terms.p4_terms, terms.p4_updated, syntax.p5_found, syntax.p5_errors,
        syntax.p5_rates, overlap.p6_found, overlap.p6_counts, encode.p7_ids, packing.p8_containers, packing.p8_fill, pii.p9_found, pii.p9_redacted,
    )
}

_TERMS = r"""
WITH r AS (SELECT DISTINCT chunk, project, file, token, freq FROM partial_vocab WHERE token IS NOT NULL),
n AS (SELECT project, file, regexp_replace(nfc_normalize(token), '^\s+|\s+$', '', 'g') AS token, coalesce(freq, 0) AS freq FROM r),
total AS (SELECT count(DISTINCT (project, file)) AS n FROM r),
t AS (SELECT token, CAST(sum(freq) AS BIGINT) AS occurrences, count(DISTINCT (project, file)) AS records FROM n WHERE token <> '' GROUP BY token)
SELECT token, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.4 * (SELECT n FROM total) THEN 'common' END AS mark FROM t
"""

SQL = {
    "p4_terms": _TERMS,
    "p4_updated": _TERMS,
    "p4_found": f"SELECT token, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p1_found": r"""
WITH RECURSIVE a AS (SELECT project, regexp_extract(lower(author), '([^\s<>()\[\]",;:]+@[^\s<>()\[\]",;:]+)', 1) AS mail FROM project_authors),
u AS (SELECT name AS project, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://', ''), '[?#].*$', ''), '^[^/@]*@', ''), '^([^/:]+):(?:[0-9]+/)?', '\1/'), '^www\.', '') AS u FROM project_list),
k AS (
  SELECT project, 'a:' || mail AS key FROM a WHERE mail <> '' AND regexp_extract(mail, '([^@]*)$', 1) LIKE '%.%' AND regexp_extract(mail, '([^@]*)$', 1) NOT LIKE 'localhost%' AND split_part(mail, '@', 1) NOT IN (""" + ", ".join(f"'{w}'" for w in splits._PLACEHOLDER_LOCAL) + r""")
  UNION SELECT project, 'r:' || regexp_replace(regexp_replace(regexp_extract(u, '^([^/]+/+[^/]+/+[^/]+)', 1), '/+', '/', 'g'), '\.git$', '') FROM u WHERE regexp_matches(u, '^[^/]+/+[^/]+/+[^/]+')
  UNION SELECT project, 'n:' || lower(regexp_replace(project, '^\d+_', '')) FROM (SELECT project FROM projects UNION SELECT name FROM project_list UNION SELECT project FROM project_authors) WHERE project IS NOT NULL),
e AS (SELECT DISTINCT x.project AS a, y.project AS b FROM k x JOIN k y ON x.key = y.key AND x.project <> y.project),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
SELECT a AS project, least(a, min(b)) AS group_key FROM c GROUP BY a
""",
}
