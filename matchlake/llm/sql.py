"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"



def _mixing(rounds: int = 24, block: int = 65536, most: int = 3, seed: int = 1) -> str:
    """Words by source, targets by sharing the excess again and again, blocks by a fixed hash, and the last block of each source cut at its target."""
    steps = ["l0 AS (SELECT CAST(sum(source_size) AS BIGINT) AS total, CAST(sum(weight) AS BIGINT) AS shares FROM s)"]
    for k in range(rounds):
        above = f"{most} * source_size < CAST(total AS DOUBLE) * weight / CAST(shares AS DOUBLE)"
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT (SELECT CAST(sum(source_size) AS BIGINT) FROM s) - CAST(sum(CASE WHEN {above} THEN {most} * source_size ELSE 0 END) AS BIGINT) AS total, CAST(sum(CASE WHEN {above} THEN 0 ELSE weight END) AS BIGINT) AS shares FROM s, l{k})")
    return f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws(':', '{seed}', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS place FROM documents),
s AS MATERIALIZED (SELECT source, source_size, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
{", ".join(steps)},
g AS (SELECT source, source_size, least(CAST({most} * source_size AS DOUBLE), CAST(total AS DOUBLE) * weight / CAST(shares AS DOUBLE)) AS target FROM s, l{rounds}),
p AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes, CAST(ceil(source_size / {block}.0::DOUBLE) AS BIGINT) AS blocks FROM g),
e AS MATERIALIZED (SELECT d.*, p.* EXCLUDE (source), target - passes * CAST(source_size AS DOUBLE) AS rest, CAST(floor(place * blocks) AS BIGINT) AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, block, any_value(rest) AS rest, sum(size) AS words, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e WHERE size > 0 GROUP BY source, block),
c AS (SELECT source, block AS cut, rest - before AS room FROM b WHERE before < rest AND rest <= before + words),
i AS (SELECT e.source, place, any_value(room) AS room, sum(size) AS words FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source AND block = cut WHERE size > 0 GROUP BY e.source, place),
f AS MATERIALIZED (SELECT *, upto <= room AS fits FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY place) AS upto FROM i)),
r AS (SELECT source, any_value(room) - coalesce(max(upto) FILTER (fits), 0) AS free, CAST([] AS DOUBLE[]) AS extra FROM f GROUP BY source UNION ALL
SELECT source, free - x.words, list_append(extra, -x.other) FROM (SELECT r.source, free, extra, max({{'words': words, 'other': -place}}) AS x FROM r JOIN f ON r.source IS NOT DISTINCT FROM f.source WHERE NOT fits AND words <= free AND NOT list_contains(extra, place) GROUP BY r.source, free, extra)),
z AS (SELECT source, arg_min(free, len(extra) * -1) AS free, arg_min(extra, len(extra) * -1) AS extra FROM r GROUP BY source),
y AS (SELECT z.source, min({{'words': words, 'place': place}}).place AS one FROM z JOIN f ON z.source IS NOT DISTINCT FROM f.source WHERE NOT fits AND NOT list_contains(extra, place) AND words < 2 * free GROUP BY z.source),
k AS (SELECT f.source, max(place) FILTER (fits) AS until, list_append(any_value(extra), any_value(one)) AS extra FROM f JOIN z ON z.source IS NOT DISTINCT FROM f.source LEFT JOIN y ON y.source IS NOT DISTINCT FROM f.source GROUP BY f.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN coalesce(block < cut OR (block = cut AND (coalesce(place <= until, false) OR coalesce(list_contains(extra, place), false))), false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e LEFT JOIN c ON e.source IS NOT DISTINCT FROM c.source LEFT JOIN k ON e.source IS NOT DISTINCT FROM k.source"""


def _centroids(rounds: int = 5, n: int = 40) -> str:
    """Every round written out: distances to all centroids, the nearest, floors of exact means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT rid, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, x, c.k, list_sum(list_transform(list_zip(x, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k} c) GROUP BY rid, x)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT k, list(m ORDER BY j) AS c FROM (SELECT k, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT k, x, unnest(range(1, 65)) AS j FROM a{k}) GROUP BY k, j)) GROUP BY k),
c{k + 1} AS MATERIALIZED (SELECT c{k}.k, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (k))""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS k, x AS c FROM v ORDER BY sha256('2:' || vec_id) NULLS LAST, x LIMIT {n}),
{", ".join(steps)}
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k) JOIN v USING (rid)"""


SQL = {
    "op13_hamerly": _centroids(),
    "op11_mixing": _mixing(),
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
g AS (SELECT DISTINCT rid, doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM g GROUP BY rid),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.rid < b.rid GROUP BY a.rid, b.rid),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (rid) LEFT JOIN c ON c.a = w.doc_id""",
    "op3_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
q AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM q),
o AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(ws) >= k)),
m AS (SELECT rid, i, k, item FROM o JOIN q USING (k, g)),
h AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT rid, i, k FROM m)) GROUP BY rid),
t AS (SELECT rid, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)""",
    "op8_substring_dedup": f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
k AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
m AS (SELECT g FROM k GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 35)) AS p FROM k SEMI JOIN m USING (g))),
a AS (SELECT rid, p, ws[p] AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
s AS (SELECT rid, count(*) AS n, array_to_string(list(x ORDER BY p), ' ') AS kept FROM a ANTI JOIN c USING (rid, p) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (rid)""",
    "op10_cover_tree": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.m, vec_id)) AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
