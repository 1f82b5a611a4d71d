"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKS = rf"regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op6_warc_round_trip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
""",
    "op7_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANKS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 80),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS reached FROM u UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.reached),
c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(c.least, s.doc_id)) AS kept FROM s LEFT JOIN c ON c.doc_id = s.doc_id
""",
    "op8_benchmark_passages": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(8, len(ws)) AS k, array_to_string(ws[i : i + 7], ' ') AS t FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 7) + 1)) AS i FROM b WHERE len(ws) > 0)),
o AS (SELECT doc_id, i, k, array_to_string(ws[i : i + k - 1], ' ') AS t FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v))),
h AS (SELECT doc_id, i, o.k, item_id FROM o JOIN v ON o.t = v.t AND o.k = v.k),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
""",
    "op11_vector_codes": """
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS v FROM k, range(16) r(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)),
a0 AS (SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c.e) AS best FROM p JOIN c0 c ON c.part = p.part GROUP BY 1, 2),
s0 AS (SELECT p.part, best % 64 AS e, pos, sum(p.v[pos + 1])::BIGINT AS s, count(*) AS n FROM a0 JOIN p USING (vec_id, part), range(1024) r(pos) WHERE pos < len(p.v) GROUP BY 1, 2, 3),
m0 AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s0 GROUP BY 1, 2),
c1 AS MATERIALIZED (SELECT c0.part, c0.e, coalesce(m0.v, c0.v) AS v FROM c0 LEFT JOIN m0 ON m0.part = c0.part AND m0.e = c0.e),
a1 AS (SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c.e) AS best FROM p JOIN c1 c ON c.part = p.part GROUP BY 1, 2),
s1 AS (SELECT p.part, best % 64 AS e, pos, sum(p.v[pos + 1])::BIGINT AS s, count(*) AS n FROM a1 JOIN p USING (vec_id, part), range(1024) r(pos) WHERE pos < len(p.v) GROUP BY 1, 2, 3),
m1 AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s1 GROUP BY 1, 2),
c2 AS MATERIALIZED (SELECT c1.part, c1.e, coalesce(m1.v, c1.v) AS v FROM c1 LEFT JOIN m1 ON m1.part = c1.part AND m1.e = c1.e),
a2 AS MATERIALIZED (SELECT p.vec_id, p.part, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + c.e) AS best FROM p JOIN c2 c ON c.part = p.part GROUP BY 1, 2),
f AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY 1)
SELECT k.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256 FROM f JOIN k USING (vec_id)
""",
    "op12_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BLANKS} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN ws WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90 GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) * 100 >= (a.n + b.n - count(*)) * 90),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS doc_id, y AS reached FROM u UNION SELECT r.doc_id, u.y FROM r JOIN u ON u.x = r.reached),
c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY 1)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.least, s.doc_id)) AS component_id FROM s LEFT JOIN c ON c.doc_id = s.doc_id
""",
    "op13_phrase_collocations": rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_CAPITALS}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
o AS MATERIALIZED (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p)),
f1 AS MATERIALIZED (SELECT lang, x, count(*) AS f FROM o GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, x, y, count(*) AS f FROM o WHERE y IS NOT NULL GROUP BY ALL),
c3 AS MATERIALIZED (SELECT lang, x, y, z, count(*) AS a FROM o WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY 1),
cuts AS (SELECT c.lang, c.x || ' ' || c.y AS phrase, c.x, c.y, 2 AS k, 1 AS j, c.f AS a, l.f AS l, r.f AS r FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f1 r ON r.lang = c.lang AND r.x = c.y WHERE c.f >= 10
UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, NULL, NULL, 3, 1, c.a, l.f, r.f FROM c3 c JOIN f1 l ON l.lang = c.lang AND l.x = c.x JOIN f2 r ON r.lang = c.lang AND r.x = c.y AND r.y = c.z
UNION ALL SELECT c.lang, c.x || ' ' || c.y || ' ' || c.z, NULL, NULL, 3, 2, c.a, l.f, r.f FROM c3 c JOIN f2 l ON l.lang = c.lang AND l.x = c.x AND l.y = c.y JOIN f1 r ON r.lang = c.lang AND r.x = c.z),
scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, x, y, max(a) AS longer FROM (SELECT lang, x, y, a FROM c3 UNION ALL SELECT lang, y, z, a FROM c3) GROUP BY ALL),
kept AS (SELECT w.* FROM worst w LEFT JOIN longer o ON o.lang = w.lang AND o.x = w.x AND o.y = w.y WHERE longer IS NULL OR longer * 100 < w.a * 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
""",
}
