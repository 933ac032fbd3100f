"""DuckDB SQL for the same results, where SQL can state them."""

from __future__ import annotations

from lodeworks.llm.queries import OFFERED, SOLD

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
w AS (SELECT *, CAST(list_extract([5, 2, 1], nth % 3 + 1) AS DOUBLE) AS weight, source_size * CAST(3 AS DOUBLE) AS cap,
             CAST(list_extract([1.0, 1.5, 0.5], nth % 3 + 1) AS DOUBLE) AS a, CAST(list_extract([1.0, 0.5, 1.5], nth % 3 + 1) AS DOUBLE) AS b FROM n),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS every, sum(weight) OVER () AS weights,
             coalesce(sum(cap) OVER q, 0) AS filled, coalesce(sum(weight) OVER q, 0) AS used FROM w
      WINDOW q AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((every - filled) / (weights - used)) AS level FROM f WHERE (every - filled) / (weights - used) <= cap / weight),
t AS (SELECT source, source_size, a, b, least(cap, level * weight) AS target FROM f, l),
c AS (SELECT sum(target * (a * 2) / (a + b)) / sum(target) AS even, sum(target * (b - a) / (a + b)) / sum(target) AS tilt FROM t),
p AS (SELECT d.doc_id, d.ord, d.size, t.source_size, t.target, t.a, t.b, (t.b - t.a) / 2 AS slope, c.even, c.tilt,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
      FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source, c),
k AS (SELECT *, unnest([0, 1, 2]) AS pass FROM p),
s1 AS (SELECT *, greatest(0, least(size, floor(target) - source_size * pass - before)) AS took, (before + source_size * pass) / target AS share FROM k),
s2 AS (SELECT *, CASE WHEN slope = 0 THEN share ELSE share * (a + slope) * 2 / (a + sqrt(greatest(a * a + slope * (share * (a + slope)) * 4, 0.0))) END AS time FROM s1),
s3 AS (SELECT *, CASE WHEN took > 0 THEN round(even * time + tilt * time * time, 9) END AS pos FROM s2)
SELECT doc_id, size, source_size, target, CAST(sum(took) AS BIGINT) AS taken, max(pos) FILTER (pass = 0) AS position,
  coalesce(string_agg(CAST(took AS BIGINT) || ':' || CAST(round(pos * 1e9) AS BIGINT), ',' ORDER BY pass) FILTER (took > 0), '') AS passes
FROM s3 GROUP BY doc_id, ord, size, source_size, target, before
"""

_CLEAN = " AND ".join(f"NOT contains({{0}}, '{x}')" for x in ("<s>", "</s>", "[INST]", "[/INST]", "&lt;", "&#91;", "&amp;"))
_SHIELD = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
OP7 = rf"""
WITH u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, CASE WHEN {_CLEAN.format("role")} AND {_CLEAN.format("text")} THEN length(role) + length(text)
        ELSE length({_SHIELD.format("role")}) + length({_SHIELD.format("text")}) END + length('<s>[INST]') + length('[/INST]') + length('</s>') AS chars FROM u),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS lost, sum(chars) AS chars FROM f GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars,
  sha256(lost) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

_SOLD, _OFFERED = "|".join(SOLD), "|".join(OFFERED)
OP10 = rf"""
WITH h AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
g AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM h),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM g),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
      ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rhost, rpath, verdict)),
k AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY (rhost IS NULL), length(rhost || rpath) DESC) AS nth
      FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host,
  '^(.*\.)?(({_SOLD})-({_OFFERED})|({_OFFERED})-({_SOLD}))\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM k WHERE nth = 1
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPOKEN = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP3 = rf"""
WITH w AS (SELECT doc_id, {_SPOKEN} AS ws FROM documents), b AS (SELECT item_id, {_SPOKEN} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: ws[i:i + n - 1])) AS win FROM (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: struct_pack(i := i, win := ws[i:i + n - 1]))) AS x FROM w, ns WHERE len(ws) >= n),
h AS (SELECT doc_id, x.i AS i, dw.n AS n, item_id FROM dw JOIN bw ON dw.n = bw.n AND x.win = bw.win),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id),
dp AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w)),
bp AS (SELECT item_id, n, i, ws[i] AS a, ws[i + 1] AS b FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws))) AS i FROM b)),
sh AS (SELECT DISTINCT doc_id, item_id, n, dp.i - bp.i AS shift FROM dp JOIN bp USING (a, b)),
nw AS (SELECT sh.doc_id, sh.item_id, n, w.ws AS dws, b.ws AS bws, shift, unnest(range(greatest(1, 1 - shift), least(len(b.ws) - n + 1, len(w.ws) - n + 1 - shift) + 1)) AS k
  FROM sh JOIN w USING (doc_id) JOIN b USING (item_id)),
nr AS (SELECT DISTINCT doc_id, item_id FROM nw WHERE 10 * len(list_filter(range(0, n), lambda x: dws[k + shift + x] = bws[k + x])) >= 8 * n),
m AS (SELECT doc_id, count(*) AS n_near FROM (SELECT * FROM nr EXCEPT SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
  coalesce(n_near, 0) AS n_near
FROM w LEFT JOIN p ON w.doc_id = p.doc_id LEFT JOIN t ON w.doc_id = t.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, len(s) AS n, md5(CAST(list_sort(s) AS VARCHAR)) AS node FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, y.node AS other, y.node = x.node AS copy FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT d, b FROM r JOIN l ON m = a),
g AS (SELECT d, min(m) AS class_id FROM r GROUP BY d),
k AS (SELECT a, count(*) AS n_links, count(*) FILTER (copy) AS twins, count(DISTINCT other) FILTER (NOT copy) AS n_texts FROM l GROUP BY a)
SELECT d AS doc_id, class_id, coalesce(n_links, 0) AS n_links, 1 + coalesce(twins, 0) AS n_copies, coalesce(n_texts, 0) AS n_texts FROM g LEFT JOIN k ON a = d
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT id, unnest(list_transform(range(1, len(w) - 3), lambda i: struct_pack(i := i, win := w[i:i + 4]))) AS x FROM d WHERE len(w) > 5),
g AS (SELECT id, unnest(list(x.i)) AS i FROM x GROUP BY id, x.win HAVING count(*) > 1),
r AS (SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(i, i + 5)) AS place FROM g) GROUP BY id),
s AS (SELECT id, host, list_filter(ls, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
l AS (SELECT id, host, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
  substr(md5(trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ')), 1, 16) AS h FROM (SELECT id, host, unnest(ls) AS l FROM s)),
m AS (SELECT id, host, md5(CAST(list_sort(list(DISTINCT h)) AS VARCHAR)) AS doc FROM l GROUP BY id, host),
e AS (SELECT host, count(DISTINCT doc) AS docs FROM m GROUP BY host),
f AS (SELECT l.host, h FROM l JOIN m USING (id) JOIN e ON e.host = l.host GROUP BY l.host, h HAVING count(DISTINCT doc) > 5 AND count(DISTINCT doc) * 100 > any_value(docs) * 10),
q AS (SELECT id, sum(n) AS gone FROM l SEMI JOIN f USING (host, h) GROUP BY id),
a AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform(w, lambda y: length(y))) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(s.ls) - len(list_distinct(s.ls)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, CAST(coalesce(gone, 0) AS BIGINT) AS removed_words FROM d JOIN s USING (id) LEFT JOIN r USING (id) LEFT JOIN q USING (id)),
b AS (SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM a)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_words,
  NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < n_words * 0.3)) AS kept FROM b
"""

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_UNITS = "list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {0}) AS BIGINT))"
OP11 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_UNITS.format(256)} AS x FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
_ROUND = """
d{0} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (SELECT v.vec_id, v.p, b.e,
    list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM v JOIN b{0} b ON v.p = b.p) GROUP BY ALL),"""
_REFIT = """
m{0} AS (SELECT p, e, i, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS c
  FROM (SELECT d.p, d.e, unnest(v.x) AS c, unnest(range(len(v.x))) AS i FROM d{0} d JOIN v USING (vec_id, p)) GROUP BY p, e, i),
n{0} AS (SELECT p, e, list(c ORDER BY i) AS x FROM m{0} GROUP BY p, e),
b{1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{0} b LEFT JOIN n{0} n USING (p, e)),"""
OP12 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, {_UNITS.format(1024)} AS x FROM embeddings WHERE {_FINITE}),
v AS MATERIALIZED (SELECT vec_id, p, x[p * n + 1:(p + 1) * n] AS x FROM (SELECT *, len(x) // 4 AS n, unnest([0, 1, 2, 3]) AS p FROM k)),
b0 AS MATERIALIZED (SELECT p, e, x FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k) JOIN v USING (vec_id) WHERE e < 256),
{"".join(_ROUND.format(r) + _REFIT.format(r, r + 1) for r in range(4))}{_ROUND.format(4)}
c AS (SELECT vec_id, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM d4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h
"""

OP13 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

ORACLES: dict[str, str] = {"op3_decontaminate": OP3, "op4_jaccard_join": OP4, "op5_mix_sources": OP5, "op7_chat_format": OP7, "op8_line_quality": OP8, "op10_url_filter": OP10, "op11_hard_negatives": OP11, "op12_vector_codes": OP12, "op13_exact_dedup": OP13}
