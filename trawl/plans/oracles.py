"""DuckDB SQL with the results of the catalog's queries."""

from __future__ import annotations

import json

from trawl.operators import jsintel, redact, rules, suppress
from trawl.plans import corpus_sql
from trawl.plans.catalog import ANCHORED, BY_ID, CONTEXT, PACK, SELECTION


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def gapped(pattern: str) -> str:
    """The text before a match, and the match, as RE2 finds them; nothing at the end ends the last gap."""
    return rf"(?m)((?s:.*?))((?:{pattern})|\z)"


BLOB = "sha1(encode('blob ' || strlen({t})) || '\\x00'::BLOB || encode({t}))"
DOCS = f"docs AS (SELECT doc_id, source, text, {BLOB.format(t='text')} AS blob_id FROM documents)"
ZERO = "'\\x00'::BLOB"


def _rule_matches(rule: rules.Rule) -> str:
    w = q(gapped(rule.pattern))
    return f"""SELECT doc_id, source, blob_id, text, {q(rule.id)} AS rule_id, {q(rule.name)} AS rule_name, {q(rule.structural_id)} AS rule_sid,
      regexp_extract_all(text, {w}, 1) AS g, regexp_extract_all(text, {w}, 2) AS h, regexp_extract_all(text, {w}, 3) AS s FROM docs WHERE regexp_matches(text, {q('(?m)' + rule.pattern)})"""


def matches(pack: list[rules.Rule]) -> str:
    """CTEs up to m: a row for each match of the pack in all documents, with ids."""
    return f"""{DOCS},
  hits AS ({" UNION ALL ".join(map(_rule_matches, pack))}),
  each AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM hits),
  placed AS (SELECT doc_id, source, blob_id, rule_id, rule_name, rule_sid, text, h[i] AS matching, s[i] AS secret,
    length(array_to_string(g[1:i], '')) + length(array_to_string(h[1:i - 1], '')) AS chars FROM each WHERE h[i] <> ''),
  pre AS (SELECT *, substr(text, 1, chars) AS prefix, substr(text, 1, chars + length(matching)) AS upto FROM placed),
  m0 AS (SELECT doc_id, source, blob_id, rule_id, rule_name, rule_sid, matching, secret, text, prefix, upto, strlen(prefix)::BIGINT AS start, strlen(upto)::BIGINT AS "end",
    (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::BIGINT AS start_line, (strlen(string_split(prefix, chr(10))[-1]) + 1)::BIGINT AS start_column,
    (length(upto) - length(replace(upto, chr(10), '')) + 1)::BIGINT AS end_line, (strlen(string_split(upto, chr(10))[-1]) + 1)::BIGINT AS end_column FROM pre),
  m AS (SELECT *, sha1(encode(rule_sid) || {ZERO} || unhex(blob_id) || {ZERO} || encode(start::VARCHAR) || {ZERO} || encode("end"::VARCHAR)) AS structural_id,
    sha1(encode(rule_sid) || {ZERO} || encode('["' || base64(encode(secret)) || '"]')) AS finding_id FROM m0),
  p AS (SELECT DISTINCT ON (structural_id) * FROM m)"""


ALL = matches(PACK)
STATUS = f"""{ALL},
  v AS (SELECT m.*, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN 'invalid' WHEN quality = 1 THEN 'valid' ELSE 'undetermined' END AS status FROM m LEFT JOIN labels USING (doc_id)),
  c AS (SELECT *, CASE WHEN status = 'undetermined' THEN 0.5 WHEN status IS NOT NULL THEN 1.0 END AS confidence FROM v)"""
ROLL = "count(status) AS n_validated, avg(confidence::DOUBLE) AS confidence, min_by(status, CASE status WHEN 'valid' THEN 1 WHEN 'invalid' THEN 2 WHEN 'undetermined' THEN 3 END) AS status"
_CATEGORIES = " ".join(f"WHEN {q(r.id)} THEN {list(r.categories)!r}" for r in PACK)
FACETS = f"""{STATUS},
  f AS (SELECT finding_id, rule_id, rule_name, {ROLL}, CASE rule_id {_CATEGORIES} END AS categories FROM c GROUP BY finding_id, rule_id, rule_name),
  x AS (SELECT *, rule_name IN {tuple(SELECTION["rule"])!r} AND coalesce(status, '-') IN {tuple(SELECTION["validation"])!r} AS kept FROM f),
  e AS (SELECT 'rule' AS facet, rule_name AS value, kept FROM x UNION ALL SELECT 'category', unnest(categories), kept FROM x UNION ALL SELECT 'validation', coalesce(status, '-'), kept FROM x)"""


def _one(rule_id: str) -> str:
    return f'WITH {matches([BY_ID[rule_id]])} SELECT doc_id, start, start_line, start_column, "end", matching, secret FROM m'


_K = "page_id::VARCHAR"
SCRIPTS = f"""js AS (SELECT page_id, 'import a from ''Pkg-' || (page_id % 7) || '/sub'';' || chr(10)
  || 'fetch("' || url || '"); axios.Post( `/api/v1/é/' || {_K} || '` )' || chr(10)
  || 'const x = require(''@Scope/lib-' || (page_id % 5) || '''); cfg = {{endpoint: ''/rest/' || {_K} || ''', url: ''data:x/y''}}' || chr(10)
  || '// é https://bucket-' || {_K} || '.s3.amazonaws.com/key/' || {_K} || '.txt, and node_modules/left-pad/index.js' || chr(10)
  || 'apiKey = ''k3y' || substr(md5(url), 1, 12) || '''; //# sourceMappingURL=app.' || {_K} || '.js.map' AS text FROM pages)"""


def _spans(name: str, pattern: str, groups: int) -> str:
    """A CTE of spans: hit, g1, g2 and the characters before the hit."""
    w = q(rf"((?s:.*?))((?:{pattern})|\z)")
    own = ", ".join(f"regexp_extract_all(text, {w}, {2 + k}) AS x{k}" for k in range(1, groups + 1))
    group = lambda k: f"x{k}[i]" if k <= groups else "''"
    return f"""{name} AS (SELECT page_id, text, h[i] AS hit, {group(1)} AS g1, {group(2)} AS g2, length(array_to_string(g[1:i], '')) + length(array_to_string(h[1:i - 1], '')) AS chars
    FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, text, regexp_extract_all(text, {w}, 1) AS g, regexp_extract_all(text, {w}, 2) AS h{", " + own if own else ""} FROM js)) WHERE h[i] <> '')"""


def _artifacts(parts: list[tuple[str, str, str, str, str, str, str]], where: str = "true") -> str:
    """Artifacts from CTEs of spans: (cte, category, method, value, detail, confidence, characters before the place)."""
    rows = " UNION ALL ".join(
        f"SELECT page_id, {category} AS category, {method} AS method, {value} AS value, {detail} AS detail, {confidence} AS confidence, substr(text, 1, {before}) AS prefix FROM {cte}"
        for cte, category, method, value, detail, confidence, before in parts
    )
    line, column = "(length(prefix) - length(replace(prefix, chr(10), '')) + 1)::BIGINT", "(length(string_split(prefix, chr(10))[-1]) + 1)::BIGINT"
    return f"""a AS (SELECT page_id, category, method, value, detail, confidence, {line} AS line, {column} AS "column" FROM ({rows}) WHERE {where}),
  b AS (SELECT page_id, category, method, value, detail, confidence, min({{'line': line, 'column': "column"}}) AS place FROM a GROUP BY ALL)
  SELECT page_id, category, method, value, detail, confidence, place.line AS line, place.column AS "column" FROM b"""


_CALLED = "(chars + length(hit) - 1 - length(g2))::INT"
_TRIM = "regexp_replace(hit, '[.,;:)\\]}\"'']+$', '')"
_ENDPOINT = "strlen(value) BETWEEN 2 AND 300 AND NOT regexp_matches(lower(value), '^(data:|javascript:)') AND NOT regexp_matches(value, '[<>{}]') AND contains(value, '/')"
_NAME = """CASE WHEN regexp_matches(n, '^(node:|\\.|/)') THEN NULL WHEN starts_with(n, '@') THEN CASE WHEN contains(n, '/') THEN lower(array_to_string(string_split(n, '/')[1:2], '/')) END ELSE lower(string_split(n, '/')[1]) END"""


def _entropy(value: str) -> str:
    chars = f"string_split({value}, '')"
    return f"list_sum(list_transform(list_distinct({chars}), lambda c: -(len(list_filter({chars}, lambda y: y = c)) / length({value})::DOUBLE) * log2(len(list_filter({chars}, lambda y: y = c)) / length({value})::DOUBLE)))"


def _any(value: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({value}, {q(w)})" for w in words) + ")"


def _mask(value: str) -> str:
    ends = lambda k: f"left({value}, {k}) || '...' || right({value}, {k})"
    return f"CASE WHEN strlen({value}) <= 8 THEN '****' WHEN strlen({value}) <= 16 THEN {ends(2)} ELSE {ends(4)} END"


_COMPACT = "regexp_replace(lower(secret), '[_.-]', '', 'g')"
_OPAQUE = f"""strlen(secret) BETWEEN 12 AND 256 AND regexp_matches(secret, '[A-Za-z]') AND regexp_matches(secret, '[0-9]') AND len(list_distinct(string_split(secret, ''))) >= 6
  AND NOT {_any(_COMPACT, suppress.PLACEHOLDERS)} AND {_entropy("secret")} >= 3.0"""
_EDGES = "[ \\t\\r\\n\"''`“”‘’:：.!！?？。；;]*"


def _rows(names: str, rows: list[tuple]) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(q(v) for v in r) + ')' for r in rows)}) t({names})"


_HTTP = [r for r in rules.BUILTIN if ("http" in r.id or r.id.startswith(("tr.aws", "tr.card"))) and "query" not in r.id]


def _counted(pack: list[rules.Rule], names: str, rows: list[tuple]) -> str:
    """Rows with the number of matches that their rule, the first column, has in all documents."""
    return f"WITH {matches(pack)}, c AS (SELECT rule_id, count(*) AS n FROM m GROUP BY rule_id), r AS (SELECT * FROM {_rows(names, rows)}) SELECT r.*, coalesce(n, 0) AS n_matches FROM r LEFT JOIN c ON r.id = c.rule_id"


_SOURCES = f"""SELECT 0 AS k, source || '/' || doc_id AS path, text FROM documents UNION ALL SELECT 1, 'conv/' || conv_id || '/' || turn, text FROM conversations
  UNION ALL SELECT 2, url, html FROM pages UNION ALL SELECT 3, 'item/' || item_id, text FROM benchmark"""
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)', 1))"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _safe(value: str) -> str:
    cleaned = f"regexp_replace(regexp_replace(trim({value}), '[^\\p{{L}}\\p{{Nd}}._=-]+', '_', 'g'), '^[._\\- ]+|[._\\- ]+$', '', 'g')"
    return f"CASE WHEN {cleaned} = '' THEN '_' ELSE {cleaned} END"


MIRROR = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query FROM pages),
s AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {_safe("url_decode(s)")}) AS parts FROM u),
f AS (SELECT *, CASE WHEN len(parts) = 0 OR ends_with(path, '/') THEN list_append(parts, 'index') ELSE parts END AS names FROM s),
l AS (SELECT *, names[-1] AS last, regexp_extract(names[-1], '(\\.[^.]*)$', 1) AS ext, {_safe("query")} AS token FROM f),
n AS (SELECT *, left(last, length(last) - length(ext)) AS base, CASE WHEN strlen(token) <= 80 THEN token ELSE left(token, 80) || '_' || left(sha1(query), 8) END AS short FROM l)
SELECT page_id, array_to_string(list_concat([{_safe("host")}], names[1:len(names) - 1], [CASE WHEN query <> '' THEN CASE WHEN base = '' THEN 'index' ELSE base END || '__query_' || short || ext ELSE last END]), '/') AS path FROM n
"""

_FULL = "(url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'api_token=abc' || page_id || '&x=1&Session=')"
QUERY_REDACT = f"""
WITH u AS (SELECT page_id, {_FULL} AS url FROM pages),
s AS (SELECT page_id, url, strpos(url, '?') AS k FROM u),
p AS (SELECT *, substr(url, k + 1) AS rest FROM s),
r AS (SELECT *, string_split(rest, '#')[1] AS query, CASE WHEN contains(rest, '#') THEN substr(rest, strpos(rest, '#')) ELSE '' END AS fragment FROM p)
SELECT page_id, substr(url, 1, k) || array_to_string(list_transform(string_split(query, '&'), lambda p: CASE WHEN regexp_matches(lower(string_split(p, '=')[1]), 'token|secret|password|passwd|key|auth|session|jwt')
  AND length(p) > length(string_split(p, '=')[1]) + 1 THEN string_split(p, '=')[1] || '=<redacted>' ELSE p END), '&') || fragment AS redacted FROM r
"""


def _replace(value: str, pattern: str, by: str) -> str:
    return f"regexp_replace({value}, {q(pattern)}, {q(by)}, 'g')"


_REDACTED = "text"
for _pattern, _by in (
    (redact.URL, "ORIGIN_REDACTED"), (redact.HOSTNAME, "HOST_REDACTED"), (redact.AUTH, r"\1\2 SECRET_VALUE_REDACTED"), (redact.COOKIE, r"\1COOKIE_VALUE_REDACTED"),
    (redact.QUERY_SECRET, r"\1SECRET_VALUE_REDACTED"), (redact.SECRET, r"\1SECRET_CANDIDATE"), (redact.RANDOM, "HIGH_ENTROPY_VALUE_REDACTED"),
):
    _REDACTED = _replace(_REDACTED, _pattern, _by)

_LABELLED = """old AS (SELECT 'finding' AS target_type, doc_id::VARCHAR AS target_id, 'accept' AS status, 'first' AS comment, doc_id AS "at" FROM labels),
  new AS (SELECT 'finding', doc_id::VARCHAR, 'reject', 'second', doc_id + 1000000 FROM labels WHERE quality = 0 OR toxic = 1)"""
_AFTER = "substr(text, length(upto) + 1)"
_REST = f"CASE WHEN starts_with({_AFTER}, chr(10)) THEN substr({_AFTER}, 2) ELSE {_AFTER} END"

SQL = {
    "stream_detect": f'WITH {matches([r for r in rules.BUILTIN])} SELECT blob_id, rule_id, start, "end", matching, structural_id FROM m',
    "extract_members": "SELECT 'page-' || page_id || '.ipynb' AS path, 'cell_0_code' AS member, sha1(html) AS sha1, strlen(html)::BIGINT AS size FROM pages",
    "password_flow": f"""WITH t AS (SELECT page_id::VARCHAR AS blob_id, 'enc' || page_id AS encryptor, 'var key = ''0123456789abcdef''; function enc' || page_id || '(p) {{}}' || chr(10) || 'user.token = enc' || page_id
      || '(form.name); body.password = enc' || page_id || '(form.password);' AS text FROM pages), c AS (SELECT *, encryptor || '(form.password)' AS call FROM t)
      SELECT blob_id, (strpos(text, call) - 1)::BIGINT AS start, (strpos(text, call) - 1 + length(call))::BIGINT AS "end", encryptor, 'form.password' AS argument, false AS is_literal, '0123456789abcdef' AS aes_key FROM c""",
    "blob_ids": f"WITH {DOCS} SELECT doc_id, blob_id, strlen(text)::BIGINT AS size FROM docs",
    "binary_filter": "SELECT doc_id, contains(substr(text, 1, 8192), chr(0)) AS is_binary FROM documents",
    "match_rules": f'WITH {ALL} SELECT doc_id, blob_id, rule_id, start, "end", start_line, start_column, end_line, end_column, matching, secret FROM m',
    "match_token_assign": _one("tr.token.1"), "match_email": _one("tr.email.1"), "match_ipv4": _one("tr.ipv4.1"), "match_card": _one("tr.card.1"), "match_license": _one("tr.licence.1"),
    "match_python": f'WITH {matches([r for r in rules.BUILTIN])} SELECT doc_id, rule_id, start, "end", start_line, start_column, end_line, end_column, matching FROM m',
    "match_context": f"""WITH {matches(PACK[:3])}, k AS (SELECT *, string_split(prefix, chr(10)) AS b, string_split({_REST}, chr(10)) AS a, {_REST} AS rest FROM m)
      SELECT doc_id, rule_id, start, array_to_string(b[greatest(1, len(b) - {CONTEXT}):], chr(10)) AS before,
      CASE WHEN len(a) > {CONTEXT} THEN array_to_string(a[1:{CONTEXT}], chr(10)) || chr(10) ELSE rest END AS after FROM k""",
    "dedup_content": f"WITH {ALL} SELECT doc_id, blob_id, rule_id, start, secret FROM (SELECT *, row_number() OVER (PARTITION BY blob_id, rule_id, secret ORDER BY start, doc_id) AS n FROM m) WHERE n = 1",
    "dedup_location": f'WITH {ALL} SELECT structural_id, rule_id, blob_id, start, "end" FROM p',
    "match_ids": f"WITH {ALL} SELECT doc_id, rule_id, start, structural_id, finding_id FROM m",
    "findings_group": f"WITH {ALL} SELECT finding_id, rule_id, rule_name, secret, count(*) AS n_matches, count(DISTINCT blob_id) AS n_blobs FROM p GROUP BY finding_id, rule_id, rule_name, secret",
    "findings_top3": f"""WITH {ALL} SELECT finding_id, rank::INT AS rank, structural_id, blob_id, start FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY blob_id, start, "end", structural_id) AS rank FROM p) WHERE rank <= 3""",
    "summary_by_rule": f"WITH {ALL} SELECT rule_id, count(*) AS n_matches, count(DISTINCT finding_id) AS n_findings, count(DISTINCT blob_id) AS n_blobs FROM p GROUP BY rule_id",
    "stats_bytes": f"WITH {DOCS} SELECT count(*) AS n_rows, count(DISTINCT blob_id) AS n_blobs, sum(strlen(text))::BIGINT AS n_bytes FROM docs",
    "entropy_filter": f"WITH {matches(PACK[:1])} SELECT doc_id, start, round({_entropy('secret')}, 6) AS entropy, {_OPAQUE} AS opaque FROM m",
    "mask_values": f"WITH {ALL} SELECT doc_id, rule_id, start, {_mask('secret')} AS masked FROM m",
    "suppress_prompts": f"""WITH v AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^{_EDGES}|{_EDGES}$', '', 'g') AS v FROM conversations)
      SELECT conv_id, turn, CASE WHEN {_any("v", suppress.PASSWORD_WORDS)} THEN {_any("v", suppress.PASSWORD_PROMPTS)} ELSE contains(lower(v), 'password') AND {_any("lower(v)", suppress.ENGLISH_PROMPTS)} END AS prompt FROM v""",
    "rule_include_exclude": f"SELECT id, name, structural_id, sha1(regexp_replace(pattern, '\\(\\?P<[^>]+>', '(', 'g')) AS computed_id, n_matches FROM ({_counted(_HTTP, 'id, name, structural_id, pattern', [(r.id, r.name, r.structural_id, r.pattern) for r in _HTTP])})",
    "ruleset_semi": _counted([r for r in rules.BUILTIN if "identifier" in r.categories], "id, name", [(r.id, r.name) for r in rules.BUILTIN if "identifier" in r.categories]),
    "incremental_anti": f"WITH {DOCS} SELECT doc_id, blob_id FROM docs WHERE blob_id NOT IN (SELECT blob_id FROM docs JOIN labels USING (doc_id))",
    "combined_sources": f"WITH s AS ({_SOURCES}), b AS (SELECT *, {BLOB.format(t='text')} AS blob_id FROM s WHERE text IS NOT NULL) SELECT blob_id, path, strlen(text)::BIGINT AS size FROM (SELECT *, row_number() OVER (PARTITION BY blob_id ORDER BY k, path) AS n FROM b) WHERE n = 1",
    "facet_counts": f"WITH {FACETS} SELECT facet, value, count(*) AS n FROM e GROUP BY facet, value",
    "facet_filtered": f"WITH {FACETS} SELECT facet, value, count(*) FILTER (kept) AS n FROM e GROUP BY facet, value",
    "validation_rollup": f"WITH {STATUS} SELECT finding_id, {ROLL} FROM c GROUP BY finding_id",
    "provenance_first": f"WITH {ALL}, f AS (SELECT blob_id, min_by('/corpus/' || source || '/' || doc_id, doc_id) AS path FROM docs GROUP BY blob_id) SELECT structural_id, rule_id, path FROM p JOIN f USING (blob_id)",
    "annotate_upsert": f'WITH {_LABELLED} SELECT target_type, target_id, max_by(status, "at") AS status, max_by(comment, "at") AS comment, max("at") AS "at" FROM (SELECT * FROM old UNION ALL SELECT * FROM new) GROUP BY target_type, target_id',
    "js_endpoints": f"WITH {SCRIPTS}, {_spans('k1', jsintel.CALL, 2)}, {_spans('k2', jsintel.FETCH, 2)}, {_spans('k3', jsintel.PROPERTY, 2)}, "
    + _artifacts([("k1", "'endpoint'", "upper(g1)", "g2", "'method call'", "'info'", _CALLED), ("k2", "'endpoint'", "''", "g2", "lower(g1) || ' call'", "'info'", _CALLED), ("k3", "'endpoint'", "''", "g2", "'url-like property'", "'info'", _CALLED)], _ENDPOINT),
    "js_cloud_urls": f"WITH {SCRIPTS}, {_spans('k', jsintel.CLOUD, 0)}, " + _artifacts([("k", "'cloud_url'", "''", _TRIM, "''", "'info'", "chars::INT")]),
    "js_subdomains": f"WITH {SCRIPTS}, {_spans('k', jsintel.DOMAIN, 0)}, " + _artifacts([("k", "'subdomain'", "''", f"lower({_TRIM})", "''", "'info'", "chars::INT")], "NOT regexp_matches(value, '\\.\\.|^\\.|\\.$|\\.(js|json|css)$|^[0-9.]*$')"),
    "js_dependencies": f"WITH {SCRIPTS}, {_spans('k1', jsintel.NODE_MODULES, 2)}, {_spans('k2', jsintel.REQUIRE, 2)}, {_spans('k3', jsintel.FROM, 2)}, "
    + f"""r AS (SELECT page_id, text, g2 AS n, 'node_modules path' AS detail, 1 AS o, (chars + length(hit) - length(g2))::INT AS k FROM k1
      UNION ALL SELECT page_id, text, g2, 'import/require', 2, (chars + strpos(hit, g2) - 1)::INT FROM k2 UNION ALL SELECT page_id, text, g2, 'import/from', 3, {_CALLED} FROM k3),
      s AS (SELECT page_id, {_NAME} AS value, detail, o, substr(text, 1, k) AS prefix FROM r),
      t AS (SELECT page_id, value, min({{'line': (length(prefix) - length(replace(prefix, chr(10), '')) + 1)::BIGINT, 'o': o, 'column': (length(string_split(prefix, chr(10))[-1]) + 1)::BIGINT, 'detail': detail}}) AS place FROM s WHERE value IS NOT NULL GROUP BY ALL)
      SELECT page_id, 'dependency' AS category, '' AS method, value, place.detail AS detail, 'info' AS confidence, place.line AS line, place.column AS "column" FROM t""",
    "js_source_maps": f"WITH {SCRIPTS}, {_spans('k', jsintel.SOURCE_MAP, 1)}, " + _artifacts([("k", "'source_map'", "''", "g1", "'external source map reference'", "'info'", "(chars + length(hit) - length(g1))::INT")]),
    "js_generic_secrets": f"WITH {SCRIPTS}, {_spans('k', jsintel.SECRET, 2)}, " + _artifacts([("k", "'generic_secret_heuristic'", "''", _mask("g2"), "g1", f"CASE WHEN round({_entropy('g2')}, 9) >= 3.5 THEN 'medium' ELSE 'low' END", _CALLED)]),
    "query_redact": QUERY_REDACT,
    "scope_filter": f"""WITH u AS (SELECT page_id, {_HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM pages)
      SELECT page_id, array_to_string(string_split(regexp_replace(host, ':[0-9]*$', ''), '.')[-2:], '.') = 'example.com' AS rdn, host = 'www.example.com' AS fqdn, host = 'www.example.com' AND scheme = 'https' AS origin FROM u""",
    "mirror_path": MIRROR,
    "repo_parse": """WITH t AS (SELECT doc_id, doc_id % 6 AS k, source AS o, 'r' || doc_id AS n FROM documents)
      SELECT doc_id, [format('https://github.com/{}/{}.git', o, n), format('git@github.com:{}/{}.git', o, n), format('https://gitlab.com/{}/sub/{}/-/tree/main', o, n), 'https://github.com/' || o,
          format('https://example.com/{}/{}', o, n), format('gitlab.com/{}/{}/', o, n)][(k + 1)::INT] AS reference,
        ['github', 'github', 'gitlab', NULL, NULL, 'gitlab'][(k + 1)::INT] AS platform, CASE WHEN k IN (3, 4) THEN NULL WHEN k = 2 THEN o || '/sub' ELSE o END AS owner,
        CASE WHEN k NOT IN (3, 4) THEN n END AS repo, CASE WHEN k NOT IN (3, 4) THEN o || CASE WHEN k = 2 THEN '/sub/' ELSE '/' END || n END AS full_path FROM t""",
    "size_parse": """WITH s AS (SELECT page_id, page_id || ['', 'B', 'KB', ' mb', 'GB', 'TB'][(page_id % 6 + 1)::INT] AS size FROM pages)
      SELECT page_id, size, CASE page_id % 6 WHEN 0 THEN page_id WHEN 1 THEN page_id WHEN 2 THEN page_id * 1024 WHEN 3 THEN page_id * 1048576 WHEN 4 THEN page_id * 1073741824 END AS bytes FROM s""",
    "redact_content": f"SELECT doc_id, {_REDACTED} AS redacted FROM documents",
    "redact_hosts": f"""WITH h AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, {q(redact.HOSTNAME)}))) AS host FROM documents), f AS (SELECT host, min(doc_id) AS first FROM h GROUP BY host)
      SELECT host, 'EXTERNAL_HOST_' || row_number() OVER (ORDER BY first, host) AS placeholder FROM f""",
    "chunk_lines": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents),
      s AS (SELECT doc_id, line, strlen(part) + 1 AS bytes, sum(strlen(part) + 1) OVER (PARTITION BY doc_id ORDER BY line) - strlen(part) - 1 AS k FROM l)
      SELECT doc_id, (k // 1000)::BIGINT AS chunk, min(line)::BIGINT AS first_line, max(line)::BIGINT AS last_line, sum(bytes)::BIGINT AS bytes FROM s GROUP BY ALL""",
    "ai_corpus_filter": """WITH p AS (SELECT page_id, string_split(string_split(url, '#')[1], '?')[1] || ['.js', '.png', '.TSX?x=1', '', '.json'][(page_id % 5 + 1)::INT] AS path FROM pages)
      SELECT page_id, path FROM p WHERE lower(regexp_extract(regexp_replace(path, '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) IN ('js', 'mjs', 'cjs', 'json', 'map', 'jsx', 'ts', 'tsx')""",
}

KEPT = f"(rule_id NOT IN ('tr.token.1', 'tr.http.query-secret') OR ({_OPAQUE}))"
_FIRST = "row_number() OVER (PARTITION BY blob_id, rule_id, secret ORDER BY start, \"end\")"
_PLACES = "pm AS (SELECT DISTINCT ON (structural_id) * FROM m ORDER BY structural_id, doc_id)"
PAGES = "js AS (SELECT page_id, html AS text FROM pages)"
_ADDRESS = q(gapped(r"\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,24})\b"))
_MARK = "['- the api key is ', 'plain ', '3. No secret: ', '| token | '][(turn % 4 + 1)::INT]"
_CLEAN = "line"
for _pattern in (r"\A\s+|\s+\z", r"\A\|+|\|+\z", r"\A\s+|\s+\z", r"\A[-*•0-9. ]+", r"\A`+|`+\z", r"\A\s+|\s+\z"):
    _CLEAN = f"regexp_replace({_CLEAN}, {q(_pattern)}, '', 'g')"
_OVERVIEW = f"""{STATUS}, cp AS (SELECT DISTINCT ON (structural_id) * FROM c ORDER BY structural_id, doc_id),
  o AS (SELECT finding_id, rule_id, rule_name, {ROLL}, count(*) AS n_matches, count(DISTINCT blob_id) AS n_blobs, min(blob_id) AS blob_id, bool_or(doc_id % 2 = 0) AS seen FROM cp GROUP BY finding_id, rule_id, rule_name),
  f1 AS (SELECT blob_id, min_by(source || '/' || doc_id, doc_id) AS path FROM docs GROUP BY blob_id)"""
_NAMED_PATH = "(regexp_replace(url, '[?#].*$', '') || ['.js', '.png', '.json'][(page_id % 3 + 1)::INT])"
_ANALYZED = ("js_endpoints", "js_cloud_urls", "js_subdomains", "js_dependencies", "js_source_maps")


def _scanned(pack: list[rules.Rule], columns: str) -> str:
    return f"WITH {matches(pack)} SELECT {columns} FROM (SELECT *, {_FIRST} AS n FROM m WHERE {KEPT}) WHERE n = 1"


SQL |= {
    "scan_full": _scanned(list(rules.BUILTIN), 'blob_id, rule_id, start, "end", start_line, secret, structural_id, finding_id'),
    "suppressed": f'WITH {matches(list(rules.BUILTIN))} SELECT doc_id, rule_id, start, "end" FROM m WHERE {KEPT}',
    "named_groups": f"""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, {_ADDRESS}, 1) AS g, regexp_extract_all(text, {_ADDRESS}, 2) AS h, regexp_extract_all(text, {_ADDRESS}, 3) AS u,
      regexp_extract_all(text, {_ADDRESS}, 4) AS v FROM documents), e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM h)
      SELECT doc_id, strlen(substr(text, 1, (length(array_to_string(g[1:i], '')) + length(array_to_string(h[1:i - 1], '')))::INT))::BIGINT AS start, u[i] AS "user", v[i] AS host, 2 AS n_groups FROM e WHERE h[i] <> ''""",
    "match_anchored": f"WITH {matches([ANCHORED])} SELECT doc_id, start, \"end\", unnest(['columns', 'python']) AS plan FROM m",
    "match_pack": f'WITH {matches([r for r in rules.pack() if len(r.names) == 1]).replace("(?P<secret>", "(")} SELECT doc_id, rule_id, start, "end", secret FROM m',
    "scan_chunked": f'WITH {ALL} SELECT structural_id, rule_id, blob_id, start, "end", start_line, end_line FROM p',
    "rule_stats": f"WITH {ALL} SELECT rule_id, 'completed' AS state, count(*) AS n_matches FROM p GROUP BY rule_id",
    "report_rows": f"""WITH {ALL}, {_PLACES}, w AS (SELECT DISTINCT finding_id, rule_id, secret FROM pm),
      o AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'old-' || finding_id ELSE finding_id END AS k, rule_id, secret, structural_id, start FROM pm WHERE doc_id % 2 = 1),
      a AS (SELECT finding_id, w.rule_id, w.secret, 'id' AS "by", structural_id, start FROM w JOIN o ON w.finding_id = k)
      SELECT * FROM a UNION ALL SELECT finding_id, w.rule_id, w.secret, CASE WHEN structural_id IS NULL THEN 'none' ELSE 'groups' END, structural_id, start
      FROM w LEFT JOIN o ON w.rule_id = o.rule_id AND w.secret = o.secret WHERE finding_id NOT IN (SELECT finding_id FROM a)""",
    "provenance_all": f"""WITH {ALL} SELECT structural_id, '/corpus/' || d.source || '/' || d.doc_id AS path, (row_number() OVER (PARTITION BY structural_id ORDER BY d.doc_id))::INT AS place
      FROM p JOIN docs d ON p.blob_id = d.blob_id""",
    "annotations_join": f"""WITH {_OVERVIEW} SELECT finding_id, n_matches, n_blobs, status, round(confidence, 6) AS confidence, CASE WHEN seen THEN 'accept' END AS annotation, path FROM o JOIN f1 USING (blob_id)""",
    "findings_sorted": f"WITH {_OVERVIEW} SELECT finding_id, n_matches, row_number() OVER (ORDER BY n_matches DESC, rule_name, finding_id) AS place FROM o",
    "scan_counters": """SELECT count(*) FILTER (NOT large AND NOT zero) AS n_scanned, coalesce(sum(n) FILTER (NOT large AND NOT zero), 0)::BIGINT AS n_bytes, count(*) FILTER (large) AS n_too_large,
      count(*) FILTER (zero AND NOT large) AS n_binary FROM (SELECT strlen(text) AS n, strlen(text) > 20000 AS large, contains(substr(text, 1, 8192), chr(0)) AS zero FROM documents)""",
    "look_back": """WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN substr(md5(event_id::VARCHAR), 1, 16) ELSE event_type || '!' END AS said, event_type IN ('click', 'view') AS parsed FROM events),
      k AS (SELECT *, count(*) FILTER (parsed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
      v AS (SELECT user_id, said, before + 1 AS number FROM k WHERE parsed)
      SELECT event_id, k.user_id, max_by(v.said, v.number) AS candidate FROM k LEFT JOIN v ON k.user_id = v.user_id AND number BETWEEN before - 7 AND before AND strlen(v.said) IN (8, 16, 24, 32)
      WHERE event_type = 'error' GROUP BY event_id, k.user_id""",
    "capture_filter": "SELECT page_id, (page_id % 7 * 50 + 150) BETWEEN 200 AND 299 AND (page_id % 5 IN (0, 2) OR page_id % 4 IN (0, 2)) AS captured FROM pages",
    "resolvable_urls": f"""WITH u AS (SELECT page_id, url, regexp_replace({_HOST}, ':[0-9]*$', '') AS host FROM pages) SELECT page_id, url FROM u
      WHERE host IN (SELECT host FROM u WHERE page_id % 2 = 0) OR NOT regexp_matches(lower(url), '^https?:') OR regexp_matches(host, '^[0-9.]+$') OR host = ''""",
    "blob_store": f"SELECT DISTINCT {BLOB.format(t='html')} AS blob_id, strlen(html)::BIGINT AS size, true AS same FROM pages",
    "store_scan": f"SELECT * FROM ({_scanned(PACK, 'structural_id, rule_id, start')}) UNION ALL SELECT DISTINCT blob_id, 'blob', strlen(text)::BIGINT FROM (WITH {DOCS} SELECT * FROM docs)",
    "insights": f"""WITH r AS (SELECT conv_id, turn, string_split({_MARK} || replace(text, chr(10), chr(10) || {_MARK}), chr(10)) AS lines FROM conversations WHERE text IS NOT NULL),
      l AS (SELECT conv_id, turn, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM r),
      c AS (SELECT conv_id, turn, i, {_CLEAN} AS x FROM l), t AS (SELECT conv_id, turn, i, CASE WHEN starts_with(x, '---') THEN '' WHEN length(x) > 220 THEN rtrim(substr(x, 1, 220)) || '...' ELSE x END AS insight FROM c),
      k AS (SELECT conv_id, turn, insight, min(i) AS i FROM t WHERE insight <> '' AND regexp_matches(lower(insight), 'api key|secret|token|credential|password|authorization|auth|unauth|cors|debug|misconfig|vulnerab|exposed|leak|admin|risk|critical|high confidence')
        AND NOT regexp_matches(lower(insight), 'none found|no findings|no secret|no obvious|not enough evidence|not observed') GROUP BY ALL)
      SELECT conv_id, turn, rank::INT AS rank, insight FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS rank FROM k) WHERE rank <= 3""",
    "link_header": "SELECT page_id, 0 AS position, url AS target FROM pages UNION ALL SELECT page_id, 1, '/s/' || page_id || '.js' FROM pages",
    "prepared_files": f"""WITH f AS (SELECT DISTINCT {BLOB.format(t='html')} AS blob_id, {_NAMED_PATH} AS path FROM pages WHERE page_id % 3 <> 1)
      SELECT blob_id, path, 'FILE_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS file_id FROM (SELECT *, row_number() OVER (ORDER BY path, blob_id) AS n FROM f)""",
    "asset_candidates": """WITH a AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['app/web/web/', 'base/web/', 'app/web/'] ELSE ['app/web/', 'base/'] END AS folders FROM pages),
      e AS (SELECT page_id, folders, unnest(range(0, len(folders))) AS place FROM a)
      SELECT page_id, place::INT AS place, 'https://h.example/' || folders[place + 1] || page_id || '.js' AS candidate FROM e""",
    "crawl_fixpoint": """SELECT 'https://h.example/' || l || page_id || x AS url, depth FROM pages,
      (VALUES ('p', '', 0), ('s', '.js', 1), ('m', '.json', 2), ('t', '.js', 3)) t(l, x, depth)""",
    "js_analyze": "WITH u AS (" + " UNION ALL BY NAME ".join(f"SELECT * FROM ({SQL[k]})" for k in _ANALYZED) + """), k AS (SELECT page_id, category, method, value, detail, min({'line': line, 'column': "column", 'confidence': confidence}) AS place FROM u GROUP BY ALL)
      SELECT page_id, category, method, value, detail, place.confidence AS confidence, place.line AS line, place.column AS "column" FROM k""",
    **{k.replace("js_", "pages_"): SQL[k].replace(SCRIPTS, PAGES) for k in (*_ANALYZED, "js_generic_secrets")},
    "sarif_rules": _counted(list(rules.BUILTIN), "id, json", [(r.id, json.dumps({"id": r.id, "name": r.name, "shortDescription": {"text": r.description}}, separators=(",", ":"), ensure_ascii=False)) for r in rules.BUILTIN]),
    "sarif_json": f"""WITH {ALL}, {_PLACES} SELECT structural_id, to_json({{'ruleId': rule_id, 'level': 'warning', 'message': {{'text': 'Found ' || rule_name}}, 'locations': [{{'physicalLocation': {{
      'artifactLocation': {{'uri': 'file:///corpus/' || source || '/' || blob_id}}, 'region': {{'startLine': start_line, 'startColumn': start_column, 'endLine': end_line, 'endColumn': end_column, 'snippet': {{'text': matching}}}}}}}}],
      'partialFingerprints': {{'matchId': structural_id}}}})::VARCHAR AS json FROM pm""",
    "report_json": f"""WITH {ALL} SELECT finding_id, to_json({{'finding_id': finding_id, 'rule_id': min(rule_id), 'rule_name': min(rule_name), 'groups': [min(secret)], 'n_matches': count(*)}})::VARCHAR AS json FROM p GROUP BY finding_id
      UNION ALL SELECT finding_id, to_json({{'finding_id': finding_id, 'match': {{'blob_id': blob_id, 'start': start, 'end': "end", 'start_line': start_line, 'start_column': start_column, 'matching': matching}}}})::VARCHAR FROM p""",
    "rfc3339": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS written, epoch_us(date_trunc('second', ts)) AS read FROM events",
}

_BEFORE, _AFTER = "array_to_string(b[greatest(1, len(b) - 1):], chr(10))", "CASE WHEN len(a) > 1 THEN a[1] || chr(10) ELSE rest END"
_LEFT = "least(length(before), greatest(room // 2, room - length(after)))"
SQL |= {
    "html_assets": f"""WITH u AS (SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, string_split({_PATH}, '/') AS parts FROM pages)
      SELECT page_id, 0 AS position, origin || '/s/' || page_id || '.css' AS asset FROM u
      UNION ALL SELECT page_id, 1, origin || array_to_string(parts[1:greatest(len(parts) - 2, 1)], '/') || '/a.js?v=1' FROM u UNION ALL SELECT page_id, 2, origin || '/c/chunk.js' FROM u""",
    "review_chunks": """WITH RECURSIVE t AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
      s AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line FROM t), l AS (SELECT doc_id, line, strlen(parts[line]) + (line < len(parts))::INT AS bytes FROM s WHERE line < len(parts) OR parts[line] <> ''),
      r AS (SELECT doc_id, line, 0 AS chunk, bytes AS held, bytes FROM l WHERE line = 1
        UNION ALL SELECT l.doc_id, l.line, CASE WHEN held + l.bytes > 3000 THEN chunk + 1 ELSE chunk END, CASE WHEN held + l.bytes > 3000 THEN l.bytes ELSE held + l.bytes END, l.bytes FROM r JOIN l ON l.doc_id = r.doc_id AND l.line = r.line + 1)
      SELECT doc_id, chunk::INT AS chunk, min(line)::BIGINT AS first_line, max(line)::BIGINT AS last_line, sum(bytes)::BIGINT AS bytes FROM r GROUP BY doc_id, chunk""",
    "report_rendered": f"""WITH {ALL}, {_PLACES}, k AS (SELECT *, string_split(prefix, chr(10)) AS b, string_split({_REST}, chr(10)) AS a, {_REST} AS rest FROM pm),
      x AS (SELECT *, {_BEFORE} AS before, {_AFTER} AS after, greatest(500 - length(matching), 0) AS room FROM k),
      y AS (SELECT *, {_LEFT} AS l, row_number() OVER (PARTITION BY finding_id ORDER BY blob_id, start, "end", structural_id) AS rank FROM x), z AS (SELECT *, least(length(after), room - l) AS r FROM y)
      SELECT finding_id, 0 AS rank, min(rule_name) || ' (' || min(rule_id) || '): ' || min(secret) || ', ' || count(*) || ' matches' AS line FROM pm GROUP BY finding_id
      UNION ALL SELECT finding_id, rank::INT, left(blob_id, 12) || ':' || start_line || ':' || start_column || ': ' || CASE WHEN l < length(before) THEN '...' ELSE '' END || CASE WHEN l > 0 THEN right(before, l) ELSE '' END
        || left(matching, 500) || left(after, r) || CASE WHEN r < length(after) OR length(matching) > 500 THEN '...' ELSE '' END FROM z WHERE rank <= 3""",
}

SQL |= corpus_sql.SQL
SQL["review_resume"] = f"""WITH r AS ({SQL["review_chunks"]})
  SELECT doc_id, count(*) AS n_chunks, count(*) AS n_done, CASE WHEN doc_id % 3 = 0 THEN 'complete' ELSE 'open' END AS before, 'complete' AS status FROM r GROUP BY doc_id"""
