"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _bucket(value: str) -> str:
    low = f"greatest(length(bin({value})) - 6, 0)::INT"
    return f"((({value}) >> ({low})) << ({low}))"


_MEASURES = ("symbols_pm", "dup_lines_pm", "repeats_pm", "word_len_pm")


def _fences(name: str, keys: str, tag: str) -> str:
    """CTEs <name>_q and <name>: the fences of the sketches of the given keys."""
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    high = "CASE name WHEN 'symbols_pm' THEN 100 WHEN 'dup_lines_pm' THEN 300 WHEN 'repeats_pm' THEN 150 ELSE 0 END"
    low = "CASE WHEN name = 'word_len_pm' THEN least(500 * q2 // 1000, q2 - 6 * (q3 - q2)) END"
    picks = ", ".join(f"max(CASE WHEN name = '{m}' THEN high END) AS {tag}_{m}_high" for m in _MEASURES)
    return f"""
{name}_b AS (SELECT {by}name, bucket, sum(n) AS n FROM sketch GROUP BY {by}name, bucket),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by}name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}name) AS total FROM {name}_b),
{name}_q AS (SELECT {by}name, max(total) AS total, min(CASE WHEN 100 * upto >= 25 * total THEN bucket END) AS q1,
  min(CASE WHEN 100 * upto >= 50 * total THEN bucket END) AS q2, min(CASE WHEN 100 * upto >= 75 * total THEN bucket END) AS q3
  FROM {name}_r GROUP BY {by}name),
{name} AS (SELECT {by}max(total) AS {tag}_n, {picks}, max(low) AS {tag}_low FROM (
  SELECT *, greatest({high}, CASE WHEN name = 'word_len_pm' THEN 2 * q2 ELSE 0 END, q2 + 6 * (q2 - q1)) AS high, {low} AS low FROM {name}_q) {group})"""


def _choose(column: str) -> str:
    return f"CASE WHEN s_n >= 200 THEN s_{column} WHEN l_n >= 200 THEN l_{column} ELSE a_{column} END"


OP1 = rf"""
WITH w AS (SELECT *, {_WORDS} AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
h AS (SELECT *, CASE WHEN len(words) < 5 THEN [] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END AS windows FROM w),
pos AS (SELECT doc_id, unnest(windows) AS window_text, unnest(range(1, len(windows) + 1)) AS i FROM h),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, window_text) AS c FROM pos) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 5) t(k) GROUP BY doc_id),
m AS (SELECT h.doc_id, lang, source, n_chars, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM h LEFT JOIN reps ON h.doc_id = reps.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END AS symbols_pm, CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines_pm,
  CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats_pm, CASE WHEN n_words > 0 THEN 1000 * word_chars // n_words ELSE 0 END AS word_len_pm FROM m),
long AS (SELECT lang, source, unnest({list(_MEASURES)}) AS name, unnest([{", ".join(_MEASURES)}]) AS v FROM f WHERE NOT base_failed),
sketch AS (SELECT lang, source, name, {_bucket("v")} AS bucket, count(*) AS n FROM long GROUP BY ALL),
{_fences("fs", "lang, source", "s")},
{_fences("fl", "lang", "l")},
{_fences("fa", "", "a")}
SELECT doc_id, f.lang, f.source, n_chars, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(f"{_bucket(m)} <= {_choose(m + '_high')}" for m in _MEASURES)} AND word_len_pm >= {_choose("low")}, false) AS kept,
  n_lines, {", ".join(_MEASURES)}, CASE WHEN s_n >= 200 THEN 'source' WHEN l_n >= 200 THEN 'lang' WHEN s_n IS NOT NULL THEN 'all' END AS fences_of
FROM f LEFT JOIN fs ON f.lang IS NOT DISTINCT FROM fs.lang AND f.source IS NOT DISTINCT FROM fs.source
  LEFT JOIN fl ON f.lang IS NOT DISTINCT FROM fl.lang CROSS JOIN fa
"""

SQL = {"op1_quality_rules": OP1}

OP4 = rf"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS h, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
f AS (SELECT *, sum(source_size) OVER () AS total, coalesce(3 * sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER o AS place
  FROM s WINDOW o AS (ORDER BY source_size * 10 // weight, source NULLS LAST)),
l AS (SELECT *, (total - stopped)::DOUBLE / weights::DOUBLE AS level FROM f),
k AS (SELECT arg_min(level, place) AS level FROM l WHERE level * weight <= 3 * source_size),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, k.level * weight) AS target FROM l, k),
c AS (SELECT source, length(bin(size)) AS class, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
p AS (SELECT c.*, target, 1024 // (8 + class) AS preference FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (target - coalesce(3 * sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(words * preference) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM p WINDOW o AS (PARTITION BY source ORDER BY class)),
r AS (SELECT source, min(class) AS first, arg_min(level, class) AS level FROM q WHERE level * preference <= 3 GROUP BY source),
e AS (SELECT q.source, class, words, target, CASE WHEN class >= first THEN least(3.0::DOUBLE, r.level * preference) ELSE 3.0::DOUBLE END AS expected
  FROM q LEFT JOIN r ON q.source IS NOT DISTINCT FROM r.source),
m AS (SELECT *, target - (sum(floor(expected)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS missing FROM e),
u AS (SELECT doc_id, d.source, size, missing, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || h || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM d LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.size > 0 AND length(bin(d.size)) = m.class),
o AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM u),
w AS (SELECT *, CASE WHEN odds IS NULL THEN 0 WHEN 2 * sum(size) OVER (PARTITION BY source, odds IS NULL ORDER BY odds, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size <= 2 * missing THEN 1 ELSE 0 END AS extra FROM o)
SELECT doc_id, size, source_size, target, (size * (coalesce(whole, 0) + extra))::BIGINT AS taken, (coalesce(whole, 0) + extra)::BIGINT AS copies
FROM w JOIN t ON w.source IS NOT DISTINCT FROM t.source
"""

SQL["op4_pareto_mix"] = OP4

_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '')"
_FIVE = " + ".join(f"substr(bits, 5 * i + {k}, 1)::INT * {1 << (5 - k)}" for k in range(1, 6))

OP5 = f"""
WITH b AS (SELECT page_id, coalesce(html, '') AS html, {_BITS} AS bits, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, octet_length(html::BLOB)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_FIVE} + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
""".replace("html::BLOB", "encode(html)")

SQL["op5_warc"] = OP5

SQL["op2_sharding"] = "SELECT doc_id, lang, source, n_chars, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS text_sha256 FROM documents"


def _assigned(name: str, book: str) -> str:
    """CTE <name>: for each row and part the nearest entry of a codebook and the squared distance to it."""
    return f"""
{name}_d AS (SELECT rid, v.part, entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM v JOIN {book} b ON v.part = b.part AND v.place = b.place GROUP BY ALL),
{name} AS (SELECT rid, part, (min(d * 64 + entry) % 64)::BIGINT AS entry, min(d)::BIGINT AS d FROM {name}_d GROUP BY rid, part)"""


def _moved(name: str, book: str, assigned: str) -> str:
    """CTE <name>: the codebook with its used entries at the mean of their parts, rounded down."""
    return f"""
{name}_s AS (SELECT v.part, a.entry, v.place, sum(v.x)::BIGINT AS s, count(*) AS n FROM v JOIN {assigned} a ON v.rid = a.rid AND v.part = a.part GROUP BY ALL),
{name} AS (SELECT b.part, b.entry, b.place, CASE WHEN n IS NULL THEN b.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x
  FROM {book} b LEFT JOIN {name}_s s ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)"""


SQL["op11_annular_codes"] = f"""
WITH k AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT rid, len(embedding) // 16 AS w, unnest(embedding) AS f, unnest(range(0, len(embedding))) AS i FROM k),
v AS (SELECT rid, (i // w)::BIGINT AS part, (i % w)::BIGINT AS place, floor(256 * f::DOUBLE)::BIGINT AS x FROM u),
b0 AS (SELECT part, rid AS entry, place, x FROM v WHERE rid < 64),
{_assigned("a1", "b0")}, {_moved("b1", "b0", "a1")}, {_assigned("a2", "b1")}, {_moved("b2", "b1", "a2")}, {_assigned("a3", "b2")},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b2),
c AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (rid), h
"""

_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
  lambda s, d: list_reduce([xor(s, d), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295::BIGINT)"""

SQL["op12_conversation_trie"] = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
  substr(sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS hash FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, hash) AS place FROM t),
f AS (SELECT DISTINCT c, c - c % 5 AS b, {_CRC32} % 9 AS h FROM o),
r AS (SELECT f.c, 0 AS own, place, hash, n_bytes FROM f JOIN o ON o.c = f.b WHERE place <= h
  UNION ALL SELECT f.c, 1, place, hash, n_bytes FROM f JOIN o ON o.c = f.c WHERE place > h),
p AS (SELECT c, row_number() OVER w AS depth, n_bytes, sha256(array_to_string(list(hash) OVER w, '')) AS node FROM r WINDOW w AS (PARTITION BY c ORDER BY own, place)),
m AS (SELECT c, depth, n_bytes, node FROM p UNION ALL SELECT c, 0, 0, '' FROM f),
l AS (SELECT c, max(depth) AS length FROM m GROUP BY c),
n AS (SELECT node, depth, min(c) AS conv_id, count(*) AS n_convs, min(n_bytes) AS n_bytes FROM m GROUP BY ALL),
u AS (SELECT n.*, q.node AS parent FROM n LEFT JOIN m q ON q.c = n.conv_id AND q.depth = n.depth - 1),
k AS (SELECT parent AS node, count(*) AS n_children FROM u WHERE parent IS NOT NULL GROUP BY parent),
s AS (SELECT a.node, sum((x.n_convs - 1) * x.n_bytes)::BIGINT AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
  FROM n x LEFT JOIN k ON k.node = x.node JOIN m a ON a.c = x.conv_id AND a.depth <= x.depth GROUP BY a.node),
e AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256 FROM m JOIN l USING (c) WHERE depth = length GROUP BY node)
SELECT u.conv_id, u.depth::BIGINT AS depth, v.conv_id AS parent_conv_id, u.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM u LEFT JOIN n v ON v.node = u.parent AND v.depth = u.depth - 1 LEFT JOIN k ON k.node = u.node JOIN s ON s.node = u.node LEFT JOIN e ON e.node = u.node
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op13_circulant_minhash"] = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(words) - 3, 1) + 1), lambda i: array_to_string(words[i : i + 3], ' '))) END AS grams FROM w),
s AS (SELECT rid, md5(array_to_string(list_sort(grams), chr(10))) AS same, len(grams)::BIGINT AS n FROM g),
d AS (SELECT min(rid) AS rid, same, any_value(n) AS n FROM s WHERE n > 0 GROUP BY same),
u AS (SELECT g.rid, d.n, unnest(grams) AS gram FROM g JOIN d ON g.rid = d.rid),
p AS (SELECT a.rid AS x, b.rid AS y, a.n + b.n - count(*) AS total, count(*) AS shared FROM u a JOIN u b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY a.rid, b.rid, a.n, b.n),
l AS (SELECT x, y FROM p WHERE 100 * shared >= 80 * total),
r AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
i AS (SELECT same, min(doc_id) AS first FROM s JOIN w USING (rid) GROUP BY same),
c AS (SELECT a.same, min(first) AS component_id FROM r JOIN d a ON a.rid = r.x JOIN d b ON b.rid = r.y JOIN i ON i.same = b.same GROUP BY a.same)
SELECT w.doc_id, s.n AS n_shingles, CASE WHEN s.n = 0 THEN w.doc_id ELSE component_id END AS component_id, s.n = 0 OR w.doc_id = component_id AS kept
FROM s JOIN w USING (rid) LEFT JOIN c ON c.same = s.same
"""
