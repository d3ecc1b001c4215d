"""DuckDB SQL with the results of the queries over planted tables. Patterns and texts are written out here, not taken from the code."""

from __future__ import annotations

from trawl.plans.corpus import ENDINGS, SAMPLES


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


_BLOB = "sha1(encode('blob ' || strlen({t})) || '\\x00'::BLOB || encode({t}))"
_SIX = "['ÉCOLE-1234', 'école-1234', 'ПАРОЛЬ=9876', 'пароль=9876', 'STRAßE-abc', 'nothing']"

_SCOPE = """
WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '.')[1] || '.' || {endings}[(page_id % 8 + 1)::INT] AS host FROM pages),
s(suffix) AS (VALUES ('com'), ('uk'), ('co.uk'), ('*.ck'), ('!www.ck'), ('jp'), ('*.kobe.jp'), ('!city.kobe.jp'), ('s3.amazonaws.com')),
p AS (SELECT page_id, host, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS n FROM h),
t AS (SELECT *, array_to_string(labels[len(labels) - n + 1 :], '.') AS tail, '*.' || array_to_string(labels[len(labels) - n + 2 :], '.') AS wild FROM p),
m AS (SELECT page_id, max(CASE WHEN s.suffix = '!' || tail THEN n - 1 END) AS except_n, max(CASE WHEN s.suffix = tail OR (n > 1 AND s.suffix = wild) THEN n END) AS rule_n
  FROM t LEFT JOIN s ON s.suffix IN (tail, wild, '!' || tail) GROUP BY page_id),
k AS (SELECT h.page_id, host, string_split(host, '.') AS labels, coalesce(except_n, rule_n, 1) AS n FROM h JOIN m USING (page_id))
SELECT page_id, host, CASE WHEN len(labels) > n THEN array_to_string(labels[len(labels) - n :], '.') END AS domain FROM k
"""

SQL = {
    "match_foreign": f"""WITH t AS (SELECT doc_id, doc_id % 6 AS k, coalesce(text, '') AS text FROM documents WHERE doc_id % 6 IN (0, 2, 4))
      SELECT doc_id, ['tr.foreign.1', 'tr.foreign.2', 'tr.foreign.3'][(k // 2 + 1)::INT] AS rule_id, (octet_length(encode(text)) + 1)::BIGINT AS start, {_SIX}[(k + 1)::INT] AS matching FROM t""",
    "match_samples": f"SELECT doc_id, {_list(r.id for r, _ in SAMPLES)}[(doc_id % {len(SAMPLES)} + 1)::INT] AS rule_id, 1::BIGINT AS n_matches FROM documents",
    # Of eight kinds of planted lines three hold a password, two a client secret, two an address and one a token; predicates leave one, one, one and none.
    "suppressed_planted": """WITH t AS (SELECT (conv_id + turn) % 8 AS k FROM conversations),
      r(k, rule_id, kept) AS (VALUES (0, 'tr.password.1', 0), (1, 'tr.password.1', 0), (2, 'tr.password.1', 1), (3, 'tr.client-secret.1', 0), (4, 'tr.client-secret.1', 1),
        (5, 'tr.http.query-secret', 0), (6, 'tr.http.query-secret', 1), (7, 'tr.token.1', 0))
      SELECT rule_id, count(*) AS n_found, sum(kept)::BIGINT AS n_kept FROM t JOIN r USING (k) GROUP BY rule_id""",
    "paired_credentials": """WITH t AS (SELECT doc_id, doc_id % 5 AS k, doc_id::VARCHAR AS n FROM documents)
      SELECT doc_id, 'AKIA' || translate(upper(substr(md5(n), 1, 16)), '0189', 'GHIJ') AS key, CASE WHEN k = 2 THEN NULL ELSE sha1(n || ['a', 'b', '', 'd', 'g'][(k + 1)::INT]) END AS secret,
        ['behind', 'before', NULL, 'before', 'behind'][(k + 1)::INT] AS side, [400, 300, NULL, 20, 60][(k + 1)::INT]::BIGINT AS distance FROM t""",
    "scope_suffix": _SCOPE.format(endings=_list(ENDINGS)),
    "mirror_folder": f"""WITH u AS (SELECT 'https://h.example/p/' || (page_id % 100) || '/page.html#' || page_id AS url, html AS content FROM pages
        UNION ALL SELECT 'https://d.example/' || source || '/' || doc_id || '.env', text FROM documents)
      SELECT url, {_BLOB.format(t="content")} AS blob_id, octet_length(encode(content))::BIGINT AS size, true AS same, true AS same_size FROM u WHERE content IS NOT NULL""",
    "store_filtered": """WITH b AS (SELECT text, min(CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END) AS run FROM documents WHERE text IS NOT NULL GROUP BY text),
      r AS (SELECT unnest([0, 1, 2]) AS run)
      SELECT r.run, count(b.text) AS n_new FROM r LEFT JOIN b ON r.run = b.run GROUP BY r.run UNION ALL SELECT -1, count(*) FROM b""",
    "pages_scripts": """SELECT page_id, 'endpoint' AS category, '/api/v2/items/' || page_id AS value FROM pages
      UNION ALL SELECT page_id, 'cloud_url', 'bucket-' || page_id || '.s3.amazonaws.com/a.txt' FROM pages""",
    "rule_effort": """WITH e(rule_id, pattern) AS (VALUES ('tr.token.1', '\\btoken = "([0-9a-f]{32,64})"'), ('tr.email.1', '\\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,24})\\b'),
        ('tr.ipv4.1', '\\b((?:[0-9]{1,3}\\.){3}[0-9]{1,3})\\b'), ('tr.card.1', '\\b([0-9]{16})\\b'), ('tr.licence.1', '((?:Licensed under|Released under|licensed under)[^\\n]{0,120})')),
      t AS (SELECT rule_id, pattern, coalesce(text, '') AS text FROM documents, e),
      u AS (SELECT rule_id, len(regexp_extract_all(text, pattern)) AS n FROM t WHERE CASE rule_id WHEN 'tr.token.1' THEN contains(text, 'token = "') WHEN 'tr.email.1' THEN contains(text, '@')
        WHEN 'tr.ipv4.1' THEN contains(text, '.') WHEN 'tr.licence.1' THEN contains(text, 'ed under') AND (contains(lower(text), 'licensed under') OR contains(lower(text), 'released under')) ELSE true END)
      SELECT rule_id, 'completed' AS state, count(*) AS n_tried, sum(n)::BIGINT AS n_matches FROM u GROUP BY rule_id""",
}
