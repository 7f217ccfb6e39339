"""DuckDB SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

#: Base-32 text of a SHA-1: five hexadecimal digits at a time are four of 32 letters.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST('0x' || substr({h}, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) >> s) & 31 AS INTEGER) + 1, 1)), '')), '')"""

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
best AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32.format(h='p.h')} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN best ON best.h = p.h"""

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, min(r.b) AS component_id,
       v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id"""

_WORDS = ("regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP7 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.s = dw.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit,
       CAST(coalesce(len(items.items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items.items, ','), '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

#: Hexadecimal text stands for the bytes: byte i (from 0) is the two digits at 2 i + 1.
OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n
           FROM documents),
win AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 400)) AS m
        FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM d WHERE n >= 200)),
twice AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.i FROM win JOIN twice ON twice.m = win.m),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (
          SELECT doc_id, i, sum(CASE WHEN i - last <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
          FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) AS last FROM hit))
        GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before,
               coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), -1) AS following FROM run),
kept AS (SELECT g.doc_id, CAST(sum(g.b - g.a) AS BIGINT) AS n_removed, count(*) AS n_spans,
                string_agg(substr(d.x, CAST(2 * g.before + 1 AS BIGINT), CAST(2 * (g.a - g.before) AS BIGINT))
                           || CASE WHEN g.following < 0 THEN substr(d.x, CAST(2 * g.b + 1 AS BIGINT)) ELSE '' END, '' ORDER BY g.a) AS x
         FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

#: Vectors that take part in a search or a comparison by inner product.
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

#: CRC-32 of a number in decimal digits, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split(CAST({x} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda a, c: list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0],
                             lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, c)),
    CAST(4294967295 AS BIGINT)), 4294967295)"""

#: Equal words at one distance follow each other in a run; a run whose period is a multiple of
#: another's that covers it has the smaller period.
OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {_CRC32.format(x='doc_id')} AS h
           FROM documents),
t AS (SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, (h // 10) % 8 AS r FROM d),
v AS (SELECT doc_id, n, unnest(range(0, n)) AS i, w, a, 1 + (n - a) // (3 + r) AS p FROM t),
x AS (SELECT doc_id, n, i, w[CAST(CASE WHEN a IS NOT NULL AND i >= a THEN a + (i - a) % p ELSE i END AS BIGINT) + 1] AS word FROM v),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x y ON y.doc_id = x.doc_id AND y.word = x.word AND y.i > x.i
      AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l
      FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e) GROUP BY doc_id, q, k
      HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT * FROM g WHERE NOT EXISTS (
           SELECT 1 FROM g o WHERE o.doc_id = g.doc_id AND o.q < g.q AND g.q % o.q = 0 AND o.s <= g.s AND o.s + o.l >= g.s + g.l)),
every AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS sha
          FROM runs GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(l AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i
         WHERE gone.i IS NULL GROUP BY x.doc_id)
SELECT t.doc_id, coalesce(every.n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
       coalesce(every.sha, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN every ON every.doc_id = t.doc_id LEFT JOIN best ON best.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id"""

OP12 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS DOUBLE)) AS c
           FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, v.label = a.label AS alike, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score
      FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id AND len(v.c) = len(a.c)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE alike) WHERE n <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS n
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
       AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE n <= 5"""

OP13 = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE {_SOUND} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e) AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20"""

ORACLES = {"op1_warc": OP1, "op2_embedding_near_dedup": OP2, "op7_decontamination": OP7, "op9_suffix_array_dedup": OP9,
           "op11_periodic_runs": OP11, "op12_hard_negatives": OP12, "op13_nearest_neighbours": OP13}
