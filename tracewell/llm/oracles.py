"""DuckDB SQL for the queries of this subpackage that SQL can express.  Learned verdicts, edit distances,
flows, secret links and byte windows are held against brute-force versions in the tests instead."""

from __future__ import annotations

import math

from . import license_scan

WORDS = r"regexp_extract_all(coalesce({x}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(x=LOWER.format(x='text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""


def substring_dedup() -> str:
    return f"""
WITH w AS (SELECT doc_id, {WORDS.format(x='text')} AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM w)),
again AS (SELECT doc_id, p FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) >= 2)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
m AS (SELECT e.doc_id, e.word, e.p, coalesce(max(CASE WHEN a.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY e.doc_id ORDER BY e.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM each e LEFT JOIN again a ON a.doc_id = e.doc_id AND a.p = e.p),
k AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (gone = 0) AS kept FROM m GROUP BY 1)
SELECT w.doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""


def licenses() -> str:
    places = []
    for phrase, label in license_scan.PHRASES:
        parts = " AND ".join(f"w[i + {k}] = '{p}'" if k else f"w[i] = '{p}'" for k, p in enumerate(phrase.split()))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {parts}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    template = ", ".join(f"({n}, '{label}', {sorted(set(t.split()))}, {math.ceil(license_scan.THRESHOLD * len(set(t.split())) - 1e-9)}, {repr(word) if word else 'NULL'}, {repr(without) if word else 'NULL'})" for n, (label, t, word, without) in enumerate(license_scan.TEMPLATES))
    token = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {LOWER.format(x='text')} AS text FROM documents),
w AS (SELECT doc_id, {token.format(x='text')} AS w FROM d),
b AS (SELECT doc_id, len(w) AS n_words, list_concat(list_concat({places[0]}, {places[1]}), list_concat({places[2]}, {places[3]})) AS places FROM w),
t(n, label, own, need, word, without) AS (VALUES {template}),
l AS (SELECT doc_id, {token.format(x='line')} AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
h AS (SELECT doc_id, CASE WHEN word IS NULL OR list_contains(block, word) THEN label ELSE without END AS label, len(list_intersect(own, block)) AS c, len(own) AS m FROM l, t WHERE len(list_intersect(own, block)) >= need),
a AS (SELECT doc_id, list(DISTINCT label) AS added, max(c / m) AS share FROM h GROUP BY 1)
SELECT b.doc_id, n_words, len(places) AS n_base, list_min(list_transform(places, lambda p: p.at)) AS first_word, list_max(list_transform(places, lambda p: p.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(places, lambda p: p.label), coalesce(added, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score FROM b LEFT JOIN a ON a.doc_id = b.doc_id"""


def archives() -> str:
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM f"""


VECTORS = "SELECT vec_id, {label} AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


def hard_negatives() -> str:
    return f"""
WITH v AS (SELECT DISTINCT * FROM ({VECTORS.format(label='CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END')} AND label IS NOT NULL)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * s.score BETWEEN 80 * positive_score AND 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


def centroids(k: int = 40, rounds: int = 5) -> str:
    steps = [
        f"v AS MATERIALIZED ({VECTORS.format(label='0')} AND len(embedding) = 64)",
        "x AS MATERIALIZED (SELECT vec_id, unnest(q) AS x, unnest(range(64)) AS d FROM v)",
        f"c0 AS MATERIALIZED (SELECT k, unnest(q) AS c, unnest(range(64)) AS d FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, q FROM v) WHERE k < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, k, distance FROM (SELECT vec_id, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM x JOIN c{i} USING (d) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, k) = 1)")
        if i < rounds:
            steps.append(f"s{i} AS (SELECT k, d, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{i} USING (vec_id) GROUP BY 1, 2)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, c{i}.d, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{i} LEFT JOIN s{i} ON s{i}.k = c{i}.k AND s{i}.d = c{i}.d)")
    return f"""
WITH {", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (k)"""


def oracle_sql() -> dict[str, str]:
    return {"op12_hard_negatives": hard_negatives(), "op13_centroids": centroids(), "op2_minhash_dedup": near_duplicates(), "op4_substring_dedup": substring_dedup(), "op7_license_scan": licenses(), "op8_warc_zip": archives()}
