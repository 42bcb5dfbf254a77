"""DuckDB SQL with the same rows as the queries of tracewell.queries, for all that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

K = "CAST(json_extract_string(props, '$.k') AS INT)"

SQL["feed_salience"] = f"""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day, {K} AS k FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-31'),
c AS (SELECT user_id, day, count(DISTINCT event_type) AS sources FROM e GROUP BY ALL),
h AS (SELECT event_id AS head, event_type AS kind, ts, sources,
  CASE WHEN least(value / 100, 1.0) > 0 THEN least(value / 100, 1.0) ELSE CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.6 WHEN 'click' THEN 0.5 ELSE 0.4 END END AS imp,
  CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.8 WHEN 'click' THEN 0.3 WHEN 'view' THEN 0.0 WHEN 'error' THEN 0.5 END AS bonus,
  pow(CAST(0.5 AS DOUBLE), (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 1e6 / 3600 / 48) AS rec,
  (k / 100.0)::DOUBLE * exp(-date_diff('day', DATE '2024-01-31', DATE '2024-11-05') / 60.0::DOUBLE) AS elec
  FROM e JOIN c USING (user_id, day))
SELECT head, kind, ts, round(rec, 4) AS recency, round(ln(1 + sources::DOUBLE), 4) AS source_part, round(imp::DOUBLE, 4) AS importance_part, round(bonus::DOUBLE, 4) AS verification, round(elec, 4) AS election,
  round(1.0::DOUBLE * rec + 0.5::DOUBLE * ln(1 + sources::DOUBLE) + 0.5::DOUBLE * imp::DOUBLE + 0.5::DOUBLE * bonus::DOUBLE + 0.75::DOUBLE * elec, 6) AS salience
FROM h ORDER BY salience DESC, ts DESC, head LIMIT 50"""

SQL["content_hash_dedup"] = """
WITH d AS (SELECT doc_id, sha256(source || chr(0) || lang || chr(0) || text || chr(0)) AS content_hash FROM documents)
SELECT doc_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS r FROM d WHERE doc_id % 3 <> 0)
WHERE r = 1 AND content_hash NOT IN (SELECT content_hash FROM d WHERE doc_id % 3 = 0)"""

SQL["change_detecting_upsert"] = """
WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders),
b AS (SELECT n.*, o.o_orderkey AS k, o.o_totalprice AS p, o.o_orderstatus AS s FROM n LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON n.o_orderkey = o.o_orderkey)
SELECT o_orderkey, o_totalprice, o_orderstatus, CASE WHEN k IS NULL THEN 'insert' ELSE 'update' END AS change FROM b
WHERE k IS NULL OR o_totalprice IS DISTINCT FROM p OR o_orderstatus IS DISTINCT FROM s"""

SQL["pending_antijoin"] = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"

SQL["daily_cap"] = """
WITH u AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, r.day FROM r LEFT JOIN u ON r.day = u.day WHERE k <= greatest(3 - coalesce(n, 0), 0)"""

SQL["latest_by_priority"] = "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1"

SQL["keep_best_per_key"] = "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1"

SQL["membership_refresh"] = "SELECT l_orderkey, sha256('1:' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber)) AS member_hash FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1"

SQL["stale_embeddings"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)"

SQL["integrity_audit"] = """
SELECT 'discount_range' AS check_name, count(*) AS n FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05
UNION ALL SELECT 'line_order_known', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'order_customer_known', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'line_key_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'status_known', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')"""

SQL["observations_explode"] = f"SELECT event_id, CAST(ts AS DATE) AS asof, CAST({K} AS DOUBLE) AS value FROM events WHERE {K} % 10 <> 0"

SQL["canonical_id_validate"] = r"""
WITH c AS (SELECT *, regexp_extract(c_name, '([0-9]+)$', 1) AS n FROM customer),
m AS (SELECT c_custkey, substr(c_mktsegment, 1, 1) || substr(n, 4, 6) AS b, right(n, 2) AS f, '119-' || lower(substr(c_mktsegment, 1, 1)) || '-' || c_custkey AS l, upper(c_name) AS r FROM c)
SELECT c_custkey, CASE WHEN regexp_full_match(b, '[A-Z][0-9]{6}') THEN 'bioguide:' || b END AS bioguide, CASE WHEN regexp_full_match(f, '[0-9]{2}') THEN 'fips:' || f END AS fips,
  CASE WHEN regexp_full_match(l, '[0-9]{1,3}-(s|hr|sjres|hjres|sconres|hconres|sres|hres)-[0-9]{1,5}') THEN 'bill:' || l END AS bill,
  CASE WHEN regexp_full_match(r, '[A-Z]{2}-[A-Z]+-[0-9]{4}') THEN 'race:' || r END AS race,
  CASE WHEN regexp_full_match(b, '[A-Z][0-9]{6}') THEN 'bioguide' END AS namespace, CASE WHEN regexp_full_match(b, '[A-Z][0-9]{6}') THEN b END AS raw FROM m"""

ENTITIES = "(SELECT CAST(n_nationkey AS BIGINT) + 1000000000 AS entity_id, n_name AS name FROM nation UNION ALL SELECT s_suppkey + 2000000000, s_name FROM supplier UNION ALL SELECT p_partkey, p_name FROM part)"


def form(x: str) -> str:
    """SQL of the plain form of a mention."""
    words = f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    titles = "the honorable|honorable|hon|senator|sen|representative|rep|congressman|congresswoman|dr|mr|mrs|ms|gov|governor"
    return rf"regexp_replace(regexp_replace({words}, '^(?:{titles})\b\s*', ''), '\s+(?:jr|sr|ii|iii|iv)$', '')"


INDEX = f"(SELECT DISTINCT entity_id, {form('name')} AS form FROM {ENTITIES})"

SQL["alias_ambiguity"] = f"SELECT form, count(DISTINCT entity_id) AS owners FROM {INDEX} GROUP BY 1 HAVING owners > 1"

SQL["alias_exact_resolve"] = rf"""
WITH o AS (SELECT form, count(DISTINCT entity_id) AS n, min(entity_id) AS owner FROM {INDEX} GROUP BY 1),
m AS (SELECT s_suppkey AS mention_id, 'Sen. ' || upper(s_name) || ' (R-FL)' AS mention FROM supplier UNION ALL SELECT p_partkey + 1000000, ' @' || upper(substr(p_name, 1, 1)) || substr(regexp_replace(p_name, ' .*', ''), 2) || ' ' || upper(substr(regexp_replace(p_name, '^.* ', ''), 1, 1)) || substr(regexp_replace(p_name, '^.* ', ''), 2) || ' Jr' FROM part),
f AS (SELECT mention_id, mention, {form("ltrim(trim(mention), '@')")} AS a, {form(r"regexp_replace(ltrim(trim(mention), '@'), '\([^)]*\)', ' ', 'g')")} AS b FROM m),
j AS (SELECT f.*, x.n AS na, x.owner AS oa, y.n AS nb, y.owner AS ob FROM f LEFT JOIN o x ON x.form = a LEFT JOIN o y ON y.form = b)
SELECT mention_id, mention, CASE WHEN na = 1 THEN oa WHEN nb = 1 THEN ob END AS entity_id, CASE WHEN na = 1 OR nb = 1 THEN 'exact' ELSE 'none' END AS method,
  CASE WHEN na = 1 OR nb = 1 THEN 1 WHEN nb > 1 THEN nb ELSE 0 END AS owners FROM j"""

# The longest common subsequence by one row of its table for each letter of the mention.
SQL["alias_fuzzy_resolve"] = f"""
WITH RECURSIVE p AS (SELECT p_partkey, p_name, substr(p_name, 1, 2) || substr(p_name, 4) AS mention FROM part),
ordered(t, s) AS (SELECT t, array_to_string(list_sort(string_split({form('t')}, ' ')), ' ') FROM (SELECT mention AS t FROM p UNION SELECT p_name FROM p)),
o AS (SELECT p_name AS name, min(p_partkey) AS entity_id FROM p GROUP BY 1),
forms AS (SELECT DISTINCT entity_id, s FROM o JOIN ordered ON t = name),
x AS (SELECT DISTINCT m.s AS a, f.s AS b FROM (SELECT DISTINCT s FROM p JOIN ordered ON t = mention) m, forms f),
d(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM x
 UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN r[k - 1] + 1 ELSE 0 END)))) FROM d WHERE i < length(a)),
s AS (SELECT a, b, 200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)) AS score FROM d WHERE i = length(a)),
e AS (SELECT a, entity_id, max(score) AS score FROM s JOIN forms ON forms.s = b GROUP BY ALL),
t AS (SELECT a, max(score) AS best, arg_min(entity_id, {{'s': -score, 'e': entity_id}}) AS entity_id, coalesce(list_sort(list(score), 'DESC')[2], 0) AS second FROM e GROUP BY 1)
SELECT p_partkey, mention, CASE WHEN best >= 90 AND best - second >= 8 THEN entity_id END AS entity_id, CASE WHEN best >= 90 AND best - second >= 8 THEN round(best / 100, 4) END AS confidence FROM p JOIN ordered ON t = mention LEFT JOIN t ON t.a = s"""

SQL["review_candidates"] = f"""
WITH RECURSIVE p AS (SELECT p_partkey, p_name, 'x' || substr(p_name, 2, 1) || substr(p_name, 4) AS mention FROM part),
ordered(t, s) AS (SELECT t, array_to_string(list_sort(string_split({form('t')}, ' ')), ' ') FROM (SELECT mention AS t FROM p UNION SELECT p_name FROM p)),
o AS (SELECT p_name AS name, min(p_partkey) AS entity_id FROM p GROUP BY 1),
forms AS (SELECT DISTINCT entity_id, s FROM o JOIN ordered ON t = name),
x AS (SELECT DISTINCT m.s AS a, f.s AS b FROM (SELECT DISTINCT s FROM p JOIN ordered ON t = mention) m, forms f),
d(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM x
 UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], CASE WHEN k > 1 AND b[k - 1] = a[i + 1] THEN r[k - 1] + 1 ELSE 0 END)))) FROM d WHERE i < length(a)),
s AS (SELECT a, b, 200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)) AS score FROM d WHERE i = length(a)),
e AS (SELECT a, entity_id, max(score) AS score FROM s JOIN forms ON forms.s = b GROUP BY ALL),
t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, entity_id) <= 5)
SELECT mention, entity_id, round(score, 4) AS score FROM (SELECT DISTINCT mention FROM p) JOIN ordered ON t = mention JOIN t ON t.a = s"""

SQL["topic_word_resolve"] = """
WITH p AS (SELECT DISTINCT lower(p_type) AS kind, regexp_replace(p_name, '^.* ', '') AS noun FROM part),
w AS (SELECT DISTINCT unnest([substr(noun, 1, 3), substr(noun, 1, 4), noun, kind, kind || '_' || noun]) AS word FROM p),
t AS (SELECT kind || '_' || noun AS topic, unnest([kind, noun, kind || '_' || noun]) AS part FROM p)
SELECT word, count(DISTINCT topic) AS options, string_agg(DISTINCT topic, ',' ORDER BY topic) AS topics, CASE WHEN count(DISTINCT topic) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status
FROM w JOIN t ON lower(trim(word)) = part OR (length(trim(word)) >= 4 AND starts_with(part, lower(trim(word)))) GROUP BY word"""


def even(x: str) -> str:
    """SQL of text with quotes, dashes and white space evened out."""
    return rf"trim(regexp_replace(translate({x}, '‘’“”–—', '''''""--'), '[\t-\r ]+', ' ', 'g'))"


SQL["span_ground"] = f"""
WITH s AS (SELECT doc_id, 0 AS kind, '  ' || replace(substr(text, 1, 40), ' ', ' ' || chr(10)) || CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE '' END AS span, text FROM documents
UNION ALL SELECT doc_id, 1, b.text, d.text FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id)
SELECT doc_id, kind, length({even('span')}) >= 3 AND contains({even('text')}, {even('span')}) AS grounded FROM s"""

SQL["span_ground_items"] = f"""
WITH b AS (SELECT item_id, text AS span, dense_rank() OVER (ORDER BY item_id) - 1 AS place, (SELECT count(DISTINCT item_id) FROM benchmark) AS n FROM benchmark WHERE item_id IS NOT NULL)
SELECT doc_id, item_id, length({even('span')}) >= 3 AND contains({even('text')}, {even('span')}) AS grounded FROM documents JOIN b ON (doc_id % n + n) % n = place"""

NUMBERS = r"list_distinct(list_transform(regexp_extract_all({x}, '[0-9]+(?:[.,][0-9]+)*'), lambda n: replace(n, ',', '')))"

SQL["numbers_extract"] = f"SELECT doc_id, len(n) AS n_numbers, array_to_string(list_sort(n), ' ') AS numbers FROM (SELECT doc_id, {NUMBERS.format(x='text')} AS n FROM documents)"

SQL["claim_grounding"] = f"""
WITH c AS (SELECT conv_id * 1000 + turn AS n, text FROM conversations),
j AS (SELECT c.n, c.n % 5 = 0 AS none, p.n IS NULL AS unknown, list_sort(list_filter({NUMBERS.format(x='c.text')}, lambda x: NOT list_contains({NUMBERS.format(x="coalesce(p.text, '')")}, x))) AS extra FROM c LEFT JOIN c p ON p.n = c.n - 1)
SELECT n AS claim_id, CASE WHEN none THEN 'no citations' WHEN unknown THEN 'unknown records' WHEN len(extra) > 0 THEN 'numbers' END AS problem,
  CASE WHEN none OR unknown OR len(extra) = 0 THEN '' ELSE array_to_string(extra, ',') END AS extra FROM j"""

SQL["lexicon_scan"] = r"""
WITH b AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS surface, min(item_id) AS entity_id FROM benchmark GROUP BY 1)
SELECT doc_id, surface, entity_id FROM documents, b WHERE length(surface) >= 3 AND regexp_matches(surface, '[A-Z]') AND contains(text, surface)
AND regexp_matches(text, '(^|[^0-9A-Za-z_])' || regexp_escape(surface) || '($|[^0-9A-Za-z_])')"""

SQL["json_validate"] = f"""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'malformed' WHEN NOT {K} < 90 THEN 'range' ELSE '' END AS error, CASE WHEN event_id % 7 <> 0 AND {K} < 90 THEN {K} END AS k FROM events"""

VECTORS = "(SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS embedding, label, ts, event_type FROM embeddings JOIN events ON vec_id = event_id)"
KNN = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM
  (SELECT a.id, b.id AS neighbour, round(list_cosine_similarity(a.embedding, b.embedding), 6) AS sim FROM {VECTORS} a JOIN {VECTORS} b ON a.id <> b.id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 172800000000)) WHERE rank <= 10)"""

SQL["windowed_knn"] = f"SELECT id, neighbour, sim, rank FROM {KNN}"

SQL["windowed_knn_pruned"] = SQL["windowed_knn"]

SQL["cluster_bands"] = f"""
WITH v AS (SELECT * FROM {VECTORS}), ce AS (SELECT DISTINCT label % 5 AS cluster, label % 3 AS entity FROM v),
best AS (SELECT k.id, n.label % 5 AS cluster, max(sim) AS sim FROM {KNN} k JOIN v n ON n.id = k.neighbour GROUP BY ALL),
met AS (SELECT best.*, 1 AS overlap FROM best JOIN v USING (id) JOIN ce ON ce.cluster = best.cluster AND ce.entity = v.label % 3)
SELECT id, cluster, sim, CAST(overlap AS BIGINT) AS overlap, rank, CASE WHEN sim < 0.7 THEN 'NEW' WHEN sim >= 0.85 THEN 'ATTACH' ELSE 'TIEBREAK' END AS decision
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cluster) AS rank FROM met) WHERE rank <= 3"""

# The sequential rule, one row an iteration.
SQL["leader_cluster"] = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM {VECTORS}),
k AS MATERIALIZED (SELECT * FROM (SELECT a.n, a.label, b.n AS m, list_cosine_similarity(a.embedding, b.embedding) AS sim, row_number() OVER (PARTITION BY a.n ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.id) AS rank FROM v a JOIN v b ON b.n < a.n AND epoch_us(a.ts) - epoch_us(b.ts) <= 172800000000) WHERE rank <= 10 AND sim >= 0.2),
r(n, id, head, label) USING KEY (n) AS (SELECT n, id, id, label FROM v WHERE n = 1
 UNION SELECT w.n, w.id, CASE WHEN c.s >= 0.3 THEN c.h ELSE w.id END, w.label FROM r last JOIN v w ON w.n = last.n + 1
 LEFT JOIN (SELECT n, arg_min(h, {{'s': -s, 'h': h}}) AS h, max(s) AS s FROM (SELECT k.n, x.head AS h, max(k.sim) AS s FROM k JOIN recurring.r x ON x.n = k.m JOIN recurring.r y ON y.head = x.head AND y.label = k.label WHERE k.n = (SELECT max(n) + 1 FROM recurring.r) GROUP BY ALL) GROUP BY n) c ON c.n = w.n)
SELECT id, head FROM r"""

SQL["stream_leader_cluster"] = SQL["leader_cluster"]

SQL["leader_cluster_verdicts"] = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY ts, id) AS n FROM {VECTORS}),
k AS MATERIALIZED (SELECT * FROM (SELECT a.n, a.id, a.label, b.n AS m, b.id AS mid, list_cosine_similarity(a.embedding, b.embedding) AS sim, row_number() OVER (PARTITION BY a.n ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.id) AS rank FROM v a JOIN v b ON b.n < a.n AND epoch_us(a.ts) - epoch_us(b.ts) <= 172800000000) WHERE rank <= 10 AND sim >= 0.2),
r(n, id, head, label, s, sure) USING KEY (n) AS (SELECT n, id, id, label, CAST(NULL AS FLOAT), CAST(NULL AS DOUBLE) FROM v WHERE n = 1
 UNION SELECT w.n, w.id, CASE WHEN c.s >= 0.3 OR (w.id + t.mid) % 2 = 0 AND (w.id * 7 + t.mid) % 10 >= 6 THEN c.h ELSE w.id END, w.label, c.s, ((w.id * 7 + t.mid) % 10) / 10.0 FROM r last JOIN v w ON w.n = last.n + 1
 LEFT JOIN (SELECT n, arg_min(h, {{'s': -s, 'h': h}}) AS h, max(s) AS s FROM (SELECT k.n, x.head AS h, max(k.sim) AS s FROM k JOIN recurring.r x ON x.n = k.m JOIN recurring.r y ON y.head = x.head AND y.label = k.label WHERE k.n = (SELECT max(n) + 1 FROM recurring.r) GROUP BY ALL) GROUP BY n) c ON c.n = w.n
 LEFT JOIN k t ON t.n = c.n AND t.mid = c.h)
SELECT id, head, CASE WHEN s IS NULL THEN 'NEW' WHEN s >= 0.3 THEN 'ATTACH' ELSE 'TIEBREAK' END AS decision, CASE WHEN s < 0.3 AND sure < 0.6 THEN 1 ELSE 0 END AS review FROM r"""

SQL["centroid"] = "SELECT label, CAST(i - 1 AS INT) AS at, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, generate_series(1, 64) g(i) GROUP BY label, i"

SQL["related_links"] = f"""
WITH v AS (SELECT * FROM {VECTORS}), h AS (SELECT label AS head, max(ts) AS ts, CASE WHEN label % 2 = 0 THEN 'statement' ELSE 'other' END AS kind, label % 3 AS e FROM v GROUP BY label),
c AS (SELECT label AS head, list(x ORDER BY i) AS vec FROM (SELECT label, i, avg(embedding[i]) AS x FROM v, generate_series(1, 64) g(i) GROUP BY label, i) GROUP BY label)
SELECT a.head AS src, b.head AS dst, CASE WHEN a.kind = 'statement' AND b.kind <> 'statement' THEN 'RESPONDS_TO' ELSE 'FOLLOWS' END AS relation,
  round(least(greatest(list_cosine_similarity(x.vec, y.vec), 0.0), 1.0), 6) AS sim, CAST(a.e AS VARCHAR) AS shared
FROM h a JOIN h b ON a.e = b.e AND (a.ts > b.ts OR a.ts = b.ts AND a.head > b.head) AND epoch(a.ts) - epoch(b.ts) <= 30 * 86400 JOIN c x ON x.head = a.head JOIN c y ON y.head = b.head
WHERE list_cosine_similarity(x.vec, y.vec) >= 0"""

MEMBERS = "(SELECT *, 1 + l_linenumber % 4 AS t, [1.0, 0.8, 0.6, 0.4][1 + l_linenumber % 4]::DOUBLE AS w FROM lineitem)"
SQL["head_rollup"] = f"""
WITH m AS (SELECT * FROM {MEMBERS}),
g AS (SELECT l_orderkey AS head, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS topics, min(l_shipdate) AS event_time, 'T' || min(t) AS tier, round(sum(w * (1 - l_discount)) / sum(w), 8) AS confidence FROM m GROUP BY 1),
ty AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, l_linestatus) AS r FROM (SELECT l_orderkey, l_linestatus, count(*) AS n, min({{'a': t, 'b': l_shipdate, 'c': l_linenumber}}) AS seen FROM m GROUP BY 1, 2)) WHERE r = 1),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, l_returnflag) AS r FROM (SELECT l_orderkey, l_returnflag, count(*) AS n, min({{'b': l_shipdate, 'c': l_linenumber}}) AS seen FROM m WHERE l_returnflag <> 'N' GROUP BY 1, 2)) WHERE r = 1)
SELECT head, topics, event_time, tier, confidence, l_linestatus AS event_type, l_returnflag AS jurisdiction FROM g LEFT JOIN ty ON ty.l_orderkey = head LEFT JOIN pl ON pl.l_orderkey = head"""

SQL["span_rollup"] = f"""
WITH m AS (SELECT * FROM {MEMBERS}), s AS (
  SELECT l_orderkey AS head, 0 AS side, t AS a, l_linenumber AS b, l_partkey AS c, l_returnflag || '-' || l_linestatus AS span FROM m
  UNION ALL SELECT l_orderkey, 1, l_linenumber, l_partkey, 0, 'p' || l_partkey % 10 FROM m),
f AS (SELECT head, span, min({{'s': side, 'a': a, 'b': b, 'sp': span, 'c': c}}) AS o FROM s GROUP BY 1, 2)
SELECT head, string_agg(span, ',' ORDER BY o) AS spans FROM f GROUP BY 1"""

SQL["corroborate"] = r"""
WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]+/+([^/?#]*)', 1)) AS acc FROM pages),
k AS (SELECT page_id % 50 AS head, CASE page_id % 3 WHEN 0 THEN 'social_post|' || host || CASE WHEN acc <> '' THEN '/' || acc ELSE '' END WHEN 1 THEN 'news|' || host ELSE 'unknown|' || host END AS key, 1 + page_id % 4 AS t FROM p),
b AS (SELECT head, key, min(t) AS t FROM k GROUP BY ALL)
SELECT head, count(*) AS independent_sources, round(sum([1.0, 0.8, 0.6, 0.4][t]::DOUBLE), 4) AS score, string_agg(key, ',' ORDER BY key) AS keys, CASE WHEN count(*) >= 2 THEN 'corroborated' ELSE 'single_source' END AS status FROM b GROUP BY head"""

SQL["claim_parse_check"] = """
WITH m AS (SELECT o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS "asof", CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY ALL),
x AS (SELECT a.p, a."asof", (a.v / b.v - 1) * 100 AS pct FROM m a JOIN m b ON a.p = b.p AND b."asof" = CAST(a."asof" - INTERVAL 1 MONTH AS DATE)),
j AS (SELECT f."asof", f.pct, h.pct AS other, (CASE WHEN f.pct < 0 THEN -1 ELSE 1 END) * CAST(printf('%.1f', abs(f.pct) + CASE WHEN month(f."asof") % 5 = 0 THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS claimed FROM x f LEFT JOIN x h ON h.p = '2-HIGH' AND h."asof" = f."asof" WHERE f.p = '1-URGENT')
SELECT CAST(year("asof") * 100 + month("asof") AS BIGINT) AS span_id, 'CPIAUCSL' AS series_id, 'pct_change' AS kind, claimed, "asof" AS period,
  CASE WHEN abs(pct - claimed) <= 0.05 + 1e-9 OR coalesce(abs(other - claimed) <= 0.05 + 1e-9, false) THEN 'match' ELSE 'mismatch' END AS outcome,
  coalesce(greatest(pct, other) - least(pct, other) > 0.05 + 1e-9, false) AS disagree FROM j"""

STANCES = f"(SELECT event_id AS head, ts, user_id AS entity, {K} % 16 AS topic, event_type, value, (event_id % 10) / 10.0::DOUBLE AS c, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'view' THEN 0 WHEN 'click' THEN -1 WHEN 'error' THEN -1 END AS side, CASE event_type WHEN 'purchase' THEN 'strongly_support' WHEN 'signup' THEN 'support' WHEN 'view' THEN 'neutral_unclear' WHEN 'click' THEN 'lean_oppose' ELSE 'oppose' END AS stance FROM events)"

SQL["stance_asof_flip"] = f"""
SELECT head, entity, topic, p AS prior_head, coalesce(c >= 0.6 AND pc >= 0.6 AND side * ps = -1, false) AS flip FROM
(SELECT *, lag(head) OVER w AS p, lag(c) OVER w AS pc, lag(side) OVER w AS ps FROM {STANCES} WINDOW w AS (PARTITION BY entity, topic ORDER BY ts, head))"""

SQL["head_verdicts"] = f"""
WITH m AS (SELECT * FROM {MEMBERS}), s AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n, bool_or(l_returnflag = 'R') AS bad, bool_or(l_returnflag = 'A') AS good, bool_or(l_returnflag = 'A' AND t <= 2) AS trusted FROM m GROUP BY 1)
SELECT o_orderkey AS head, CASE WHEN NOT coalesce(bad, false) AND coalesce(trusted, false) THEN 'fact_checked' WHEN n >= 2 THEN 'corroborated' WHEN n = 1 THEN 'single_source' ELSE 'unverified' END AS status,
  round((o_orderkey % 100) / 100.0::DOUBLE * CASE WHEN coalesce(bad, false) AND NOT coalesce(good, false) THEN 0.5 ELSE 1.0 END::DOUBLE, 6) AS confidence FROM orders LEFT JOIN s ON o_orderkey = l_orderkey"""

SQL["event_race_rule_join"] = """
WITH b AS (SELECT DISTINCT l_orderkey AS head, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
s AS (SELECT o_orderkey AS head, c_nationkey AS state, 0 AS m FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT l_orderkey, s_nationkey, 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
w AS (SELECT head, state, min(m) AS m FROM s GROUP BY ALL),
r AS (SELECT n_name AS race_id, n_nationkey AS state, CASE n_nationkey % 3 WHEN 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS weight, 'Brand#' || ((n_nationkey + 5 * i) % 25 + 1) AS p_brand FROM nation, generate_series(1, 4) g(i) WHERE n_nationkey % 3 < 2)
SELECT head, race_id, CASE m WHEN 0 THEN 'state' ELSE 'politician' END AS match, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS matched_topics,
  round(weight * CASE m WHEN 0 THEN 1.0 ELSE 0.9 END::DOUBLE * ((head % 10) / 10.0::DOUBLE), 6) AS confidence
FROM b JOIN r USING (p_brand) JOIN w USING (head, state) GROUP BY head, race_id, m, weight"""

SQL["neighborhood"] = """
WITH e AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, l_returnflag AS relation, 1 - l_discount AS c, 'line ' || l_linenumber AS rationale, l_shipdate AS ts, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT src AS entity, 'out' AS direction, dst AS neighbour, * FROM e UNION ALL SELECT dst, 'in', src, * FROM e)
SELECT entity, direction, relation, neighbour, count(*) AS edge_count, round(max(c), 6) AS confidence, arg_min(rationale, {'c': -c, 'id': id, 'r': rationale}) AS rationale, max(ts) AS latest FROM u GROUP BY ALL"""

SQL["entity_dossier"] = f"""
WITH s AS (SELECT * FROM {STANCES}),
l AS (SELECT entity, string_agg(topic || '=' || stance, ',' ORDER BY topic || '=' || stance) AS stances FROM (SELECT *, row_number() OVER (PARTITION BY entity, topic ORDER BY ts DESC, head DESC) AS r FROM s) WHERE r = 1 GROUP BY 1),
t AS (SELECT entity, count(*) AS shown, max(ts) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, head DESC) AS r FROM s) WHERE r <= 20 AND value > 50 GROUP BY 1)
SELECT l.entity, stances, shown, newest FROM l LEFT JOIN t ON l.entity = t.entity"""

SQL["reactions"] = f"""
WITH s AS (SELECT *, entity * 100 + day(ts) AS h, epoch_us(ts) AS id FROM {STANCES}),
src AS (SELECT * FROM (SELECT h, 'T' || (1 + topic % 4) AS tier, 'u' || id AS url, row_number() OVER (PARTITION BY h ORDER BY 1 + topic % 4, id) AS r FROM s WHERE value > 50) WHERE r = 1),
m AS (SELECT h, entity, topic, stance, max(c) AS c FROM s GROUP BY ALL)
SELECT h AS head, entity, topic, stance, tier, url FROM (SELECT m.*, tier, url, row_number() OVER (PARTITION BY m.h, entity, topic ORDER BY c DESC, stance) AS r FROM m JOIN src ON src.h = m.h) WHERE r = 1"""

SQL["event_object"] = """
SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS members, array_to_string(list_transform(list_sort(list_distinct(list(l_suppkey))), lambda x: CAST(x AS VARCHAR)), ',') AS entities
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""

SQL["race_dossier"] = """
WITH o AS (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey),
n AS (SELECT c_nationkey, arg_max(o_orderstatus, {'d': o_orderdate, 'k': o_orderkey}) AS rating FROM o GROUP BY 1),
s AS (SELECT o.c_nationkey, any_value(rating) AS rating, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS support FROM o JOIN n ON n.c_nationkey = o.c_nationkey AND o_orderstatus = rating GROUP BY 1),
t AS (SELECT c_nationkey, count(*) FILTER (o_orderstatus = 'F') AS closed FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM o) WHERE r <= 20 GROUP BY 1)
SELECT c_nationkey, rating, support, closed FROM s JOIN t USING (c_nationkey)"""

SQL["reference_lag"] = """
WITH m AS (SELECT o_orderstatus AS s, o_orderpriority AS p, CAST(date_trunc('month', o_orderdate) AS DATE) AS "asof", CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS v FROM orders GROUP BY ALL),
l AS (SELECT *, lag(v) OVER (PARTITION BY s, p ORDER BY "asof") AS prev, row_number() OVER (PARTITION BY s, p ORDER BY "asof" DESC) AS r FROM m),
y AS (SELECT l.s, l.p, l."asof", l.v, l.prev, b.v AS b FROM l JOIN m b ON b.s = l.s AND b.p = l.p AND b."asof" = CAST(l."asof" - INTERVAL 12 MONTH AS DATE) WHERE r = 1 AND prev IS NOT NULL)
SELECT s AS series_id, p AS source, "asof", v AS level, round(v - prev, 4) AS change, round((v / b - 1) * 100, 4) AS yoy FROM
(SELECT *, row_number() OVER (PARTITION BY s ORDER BY CASE p WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, p) AS k FROM y) WHERE k = 1"""

SQL["retrieve_topk"] = f"""
WITH v AS (SELECT * FROM {VECTORS}), q AS (SELECT embedding AS e FROM v WHERE id = 0),
s AS (SELECT id, label AS head, ts, round(list_cosine_similarity(embedding, e), 6) AS sim FROM v, q),
near AS (SELECT head, max(sim) AS sim, max(ts) AS ts FROM (SELECT * FROM s ORDER BY sim DESC, id LIMIT 32) WHERE sim >= 0 AND head <> 3 GROUP BY 1),
u AS (SELECT head, 0 AS named, CAST(NULL AS DOUBLE) AS sim, max(ts) AS ts FROM s WHERE head = 3 GROUP BY 1 UNION ALL SELECT head, 1, sim, ts FROM near)
SELECT rank, head, named, sim FROM (SELECT *, row_number() OVER (ORDER BY named, sim DESC, ts DESC, head) AS rank FROM u) WHERE rank <= 8"""

SQL["number_records"] = """
WITH r AS (SELECT o_custkey AS head, l_linenumber AS place, l_orderkey * 10 + l_linenumber AS id, l_suppkey AS url, l_returnflag AS span FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY head, url, span ORDER BY place, id) AS k FROM r) WHERE k = 1)
SELECT head, n, url, span FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY place, id, url, span) AS n FROM f) WHERE n <= 30"""

SQL["trend_bins"] = """
SELECT event_id AS id, CASE WHEN hi = lo THEN 3 ELSE CAST(round((value - lo) / (hi - lo) * 7) AS INT) END AS bin FROM
(SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM events)"""

PRF = "(SELECT count(*) FILTER (g AND p) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (g AND NOT p) AS fn FROM (SELECT doc_id, coalesce(quality = 0, false) AS g, coalesce(regexp_matches(text, '[0-9]'), false) AS p FROM documents FULL JOIN labels USING (doc_id)) WHERE {w})"
RATES = "(SELECT tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM {x}))"
ALL, HALF = RATES.format(x=PRF.format(w="true")), RATES.format(x=PRF.format(w="doc_id % 2 = 0"))

SQL["prf_micro"] = f"SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM {ALL}"

SQL["pass_scorer"] = f"""
SELECT metric, round(value, 6) AS value FROM (SELECT unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM {ALL}
UNION ALL SELECT 'accuracy', avg(CASE WHEN (quality = 0) = coalesce(regexp_matches(text, '[0-9]'), false) THEN 1.0 ELSE 0.0 END) FROM labels LEFT JOIN documents USING (doc_id))"""

SQL["regression_gate"] = f"""
SELECT a.metric, round(a.value, 6) AS value, round(b.value, 6) AS was, b.value - a.value > 0.02 + 1e-12 AS regressed
FROM (SELECT unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM {ALL}) a JOIN (SELECT unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM {HALF}) b USING (metric)"""

SQL["item_diffs"] = """
WITH l AS (SELECT l_orderkey AS item, l_returnflag || '-' || l_linenumber AS label, l_shipdate < TIMESTAMP '1999-03-01' AS g, l_discount < 0.06 AS p FROM lineitem WHERE l_returnflag <> 'N'),
e AS (SELECT item, label, bool_or(g) AS g, bool_or(p) AS p FROM l WHERE g OR p GROUP BY ALL)
SELECT item, coalesce(string_agg(label, ',' ORDER BY label) FILTER (g AND NOT p), '') AS missed, coalesce(string_agg(label, ',' ORDER BY label) FILTER (p AND NOT g), '') AS extra FROM e GROUP BY item"""

SQL["stream_dedup_daily"] = "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
