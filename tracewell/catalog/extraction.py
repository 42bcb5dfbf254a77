"""Extraction: from documents and pass outputs to events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog import query, table
from tracewell.catalog.sources import NAMES_OF_STATES, STATE_LIST, state_of
from tracewell.operators import extract, ground
from tracewell.oracles import even
from tracewell.params import STATES


def pick(n, *values):
    """The value at n modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Author: @h' || page_id END AS a, CASE WHEN page_id % 4 = 0 THEN 'Sponsor: s' || page_id || chr(10) || 'Sponsor: t' END AS s, url FROM pages)
SELECT page_id, concat_ws(chr(10), a, s, CASE WHEN a IS NOT NULL OR s IS NOT NULL THEN '---' END, url) AS text FROM p""")
def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an author, sponsors, both or neither above their url as body."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages")
    author = F.when(k % 3 == 0, F.concat(F.lit("h"), k.cast("string"))).otherwise("")
    sponsors = F.when(k % 4 == 0, F.array(F.concat(F.lit("s"), k.cast("string")), F.lit(""), F.lit("t")))
    return p.select("page_id", ground.document_text(author, sponsors, F.col("url")).alias("text"))


@query("""
WITH p AS (SELECT page_id AS doc_id, page_id % 5 IN (0, 2) AS s, page_id % 3 <> 0 AS told, page_id % 2 = 1 AND page_id % 3 <> 0 AS said, (page_id % 10) / 10.0::DOUBLE AS c FROM pages),
g AS (SELECT *, s OR said AS relevant FROM p)
SELECT doc_id, relevant, CASE WHEN s THEN 1.0 WHEN told THEN c END AS confidence, CASE WHEN NOT relevant THEN CASE WHEN told THEN 'r' || doc_id ELSE 'no verdict' END END AS dropped_reason, NOT relevant AND (NOT told OR c < 0.6) AS review FROM g""")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of four sources and of none; verdicts for two of three."""
    k = F.col("page_id")
    p = table(spark, sf_dir, "pages")
    docs = p.select(k.alias("doc_id"), pick(k, "congress", "news", "fec", "social", None).alias("source"), "url")
    verdicts = p.where("page_id % 3 <> 0").select(k.alias("doc_id"), (k % 2 == 1).alias("relevant"), (k % 10 / 10).alias("confidence"), F.concat(F.lit("r"), k.cast("string")).alias("reason"))
    return extract.gate(docs, verdicts)


def core_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents with a time for even ones; a core of each, its span cut from the text with other spaces,
    for each fourth with something added."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    docs = d.select("doc_id", "text", F.when(k % 2 == 0, F.timestamp_seconds(1_700_000_000 + k)).alias("event_time"), F.timestamp_seconds(1_600_000_000 + k).alias("fetched_at"), F.concat(F.lit("u"), k.cast("string")).alias("url"), pick(k, "government_primary", "news", "social_post").alias("source_type"))
    span = F.concat(F.lit(" "), F.replace(F.substring("text", 1, 40), F.lit(" "), F.lit(" \n")), F.when(k % 4 == 0, "zz").otherwise(""))
    place = F.when(k % 5 == 0, " Federal").when(k % 5 == 1, "Nowhere").when(k % 5 == 2, F.lit(None)).otherwise(F.lower(state_of(k, 2)))
    cores = d.select("doc_id", span.alias("span"), F.when(k % 3 == 0, F.timestamp_seconds(1_500_000_000 + k)).alias("event_time"), place.alias("jurisdiction"), F.concat(F.lit("h"), k.cast("string")).alias("headline"), pick(k, "statement", "nomination").alias("event_type"), F.when(k % 2 == 0, F.concat(F.lit("a"), k.cast("string"))).alias("actor_mention"), F.lit("").alias("action"), F.when(k % 3 == 0, "o").alias("object"), (k % 10 / 10).alias("confidence"))
    return docs, cores


CORES = f"""(SELECT doc_id, CASE WHEN NOT (length({even("span")}) >= 3 AND contains({even("text")}, {even("span")})) THEN 'ungrounded' END AS error,
  CASE WHEN doc_id % 2 = 0 THEN 1700000000 + doc_id WHEN doc_id % 3 = 0 THEN 1500000000 + doc_id END AS t, CASE WHEN doc_id % 5 = 0 THEN 'federal' WHEN doc_id % 5 > 2 THEN 'fips:' || fips END AS jurisdiction, text, span
  FROM (SELECT *, ' ' || replace(substr(text, 1, 40), ' ', ' ' || chr(10)) || CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE '' END AS span, {STATE_LIST}[doc_id % {len(STATES)} + 1] AS st FROM documents) LEFT JOIN {NAMES_OF_STATES} ON abbrev = st)"""


@query(f"SELECT doc_id, coalesce(error, '') AS error, t AS seconds, jurisdiction FROM {CORES}")
def event_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: cores of documents: grounding, the document's own time first, states by name."""
    docs, cores = core_rows(spark, sf_dir)
    return extract.event_cores(cores, docs).select("doc_id", F.coalesce("error", F.lit("")).alias("error"), F.unix_seconds("event_time").alias("seconds"), "jurisdiction")


@query(f"""
WITH m AS (SELECT doc_id, text, substr(text, 1, 12) || CASE WHEN doc_id % 5 = 0 THEN 'qq' ELSE '' END AS mention, substr(text, 3, 30) AS span, (doc_id % 10) / 10.0::DOUBLE AS c FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN doc_id * 10 END AS entity_id, CASE WHEN doc_id % 3 = 0 THEN round(least(c, 0.75555), 4) ELSE c END AS confidence, CASE WHEN doc_id % 3 = 0 THEN 'fuzzy' ELSE 'none' END AS method
FROM m WHERE length({even("span")}) >= 3 AND contains({even("text")}, {even("span")}) AND length({even("mention")}) >= 3 AND contains({even("text")}, {even("mention")})""")
def mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention of each document, each fifth not in it; each third resolves."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = d.select(k.alias("mention_id"), "doc_id", F.concat(F.substring("text", 1, 12), F.when(k % 5 == 0, "qq").otherwise("")).alias("mention"), F.lit("actor").alias("role"), F.substring("text", 3, 30).alias("span"), F.lit("Agency").alias("entity_type"), (k % 10 / 10).alias("confidence"))
    found = d.where("doc_id % 3 = 0").select(k.alias("mention_id"), (k * 10).alias("entity_id"), F.lit("fuzzy").alias("method"), F.lit(0.75555).alias("confidence"))
    return extract.mention_links(m, d, found).select("doc_id", "entity_id", "confidence", "method")


@query("SELECT doc_id, 'T' AS topic, doc_id * 10 AS entity_id, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS pos FROM documents WHERE doc_id % 4 >= 2 AND doc_id % 7 > 0 AND regexp_matches(text, '[A-Za-z]{3}')")
def stance_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stances of each document, of which one can count: two are on its topic by a holder, one of
    these is surer in two of three documents; bills, votes, each seventh document, whose entity holds no
    stances, and documents without three letters in a row, which are the span, have none.  Half of the
    other documents are of no kind."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").withColumn("span", F.regexp_extract("text", "[A-Za-z]{3,}", 0))
    docs = d.select("doc_id", pick(k, "bill", "vote", "post", None).alias("kind"), "text")
    links = d.select("doc_id", (k * 10).alias("entity_id"), F.when(k % 7 == 0, "Race").otherwise("Politician").alias("entity_type"))
    rows = F.explode(F.array(
        F.struct(F.lit(1).alias("pos"), F.lit("T").alias("topic"), F.lit(0.5).alias("confidence"), F.col("span")),
        F.struct(F.lit(2).alias("pos"), F.lit("T").alias("topic"), F.when(k % 3 == 0, 0.5).otherwise(0.9).alias("confidence"), F.col("span")),
        F.struct(F.lit(3).alias("pos"), F.lit("U").alias("topic"), F.lit(1.0).alias("confidence"), F.col("span")),
        F.struct(F.lit(4).alias("pos"), F.lit("T").alias("topic"), F.lit(1.0).alias("confidence"), F.lit("not in any text ~~").alias("span")),
    ))
    s = d.select("doc_id", (k * 10).alias("entity_id"), F.lit("support").alias("position"), F.lit(0.5).alias("intensity"), rows.alias("s")).select("doc_id", "entity_id", "position", "intensity", "s.*")
    return extract.stance_rows(s, docs, links, d.select("doc_id", F.lit("T").alias("topic"))).select("doc_id", "topic", "entity_id", "pos")


@query("""
SELECT DISTINCT l_orderkey AS doc_id, l_suppkey AS src, CASE l_returnflag WHEN 'A' THEN 'VOTED_FOR' ELSE 'VOTED_AGAINST' END AS relation, 5000000000 + l_orderkey AS dst FROM lineitem WHERE l_orderkey % 3 = 1 AND l_returnflag <> 'N'
UNION ALL SELECT o_orderkey, o_custkey, 'PROPOSES', 5000000000 + o_orderkey FROM orders WHERE o_orderkey % 3 = 2""")
def payload_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as votes and bills; lines as members' casts, customers as sponsors; each third has no bill."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    docs = o.select(k.alias("doc_id"), pick(k, "vote", "vote", "bill").alias("kind"), F.when(k % 3 > 0, k + 5_000_000_000).alias("bill_entity"))
    cast = F.when(F.col("l_returnflag") == "A", "Yea").when(F.col("l_returnflag") == "R", "Nay").otherwise("Present")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("entity_id"), cast.alias("cast_str"))
    links = o.select(k.alias("doc_id"), F.col("o_custkey").alias("entity_id"), F.lit("sponsor").alias("role"))
    return extract.payload_edges(docs, members, links).select("doc_id", "src", "relation", "dst")


@query("""
WITH e AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN l_suppkey % 9 > 0 THEN 'e' || l_suppkey % 9 END AS src, CASE WHEN l_partkey % 4 = 0 THEN 'fred:X' ELSE 'e' || l_partkey % 9 END AS dst, ['AFFECTS', 'EXPOSED_TO', 'VOTED_FOR'][l_suppkey % 3 + 1] AS relation, l_discount > 0.01 AS g, l_extendedprice AS p FROM lineitem),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, src, relation, dst ORDER BY pos) AS r FROM (SELECT doc_id, pos, src, dst, relation FROM e WHERE src IS NOT NULL AND src <> dst AND relation <> 'VOTED_FOR' AND g AND (dst <> 'fred:X' OR relation = 'EXPOSED_TO') GROUP BY ALL))
SELECT doc_id, pos, src, relation, dst FROM f WHERE r = 1 AND NOT (doc_id % 2 = 0 AND relation = 'AFFECTS' AND src = 'e1')""")
def proposed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as proposed edges; even orders state that e1 affects everything in their payload."""
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.when(s % 9 > 0, F.concat(F.lit("e"), (s % 9).cast("string"))).alias("src"), F.when(p % 4 == 0, "fred:X").otherwise(F.concat(F.lit("e"), (p % 9).cast("string"))).alias("dst"), pick(s, "AFFECTS", "EXPOSED_TO", "VOTED_FOR").alias("relation"), (F.col("l_discount") > 0.01).alias("grounded"))
    payload = li.where("doc_id % 2 = 0 and relation = 'AFFECTS' and src = 'e1'").select("doc_id", "src", "relation", "dst").distinct()
    return ground.proposed_edges(li.distinct(), payload).select("doc_id", "pos", "src", "relation", "dst")


@query("SELECT event_id AS doc_id, 'low_confidence' AS kind, 'u' || user_id AS mention, 'stance:' || event_type AS field, '{\"user_id\":' || user_id || '}' AS payload, (event_id % 10) / 10.0::DOUBLE AS confidence FROM events WHERE event_id % 10 < 6")
def low_confidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of little confidence as review rows."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), "user_id", "event_type", (F.col("event_id") % 10 / 10).alias("confidence"))
    return extract.low_confidence_review(e, F.concat(F.lit("stance:"), "event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.struct("user_id"))


@query(f"""
WITH c AS (SELECT * FROM {CORES} WHERE error IS NULL)
SELECT doc_id, 'event' AS kind, concat_ws('|', CASE WHEN doc_id % 2 = 0 THEN 'statement' ELSE 'nomination' END, nullif(concat_ws(' ', CASE WHEN doc_id % 2 = 0 THEN 'a' || doc_id END, CASE WHEN doc_id % 3 = 0 THEN 'o' END), ''), CAST(coalesce(t, 1600000000 + doc_id) AS VARCHAR), jurisdiction, CASE WHEN doc_id % 2 = 0 THEN 'x,y' ELSE '' END) AS value FROM c
UNION ALL SELECT doc_id, 'source', 'u' || doc_id || '|' || ['T1', 'T3', 'T4'][doc_id % 3 + 1] || '|h' || doc_id FROM c
UNION ALL SELECT doc_id, 'entity', 'voter|||' FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT doc_id, 'entity', 'actor|x|support|0.5' FROM documents WHERE doc_id % 3 = 0""")
def event_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cores of documents as events, their sources, and mention and stance rows."""
    k = F.col("doc_id")
    docs, outputs = core_rows(spark, sf_dir)
    cores = extract.event_cores(outputs, docs)
    topics = docs.where("doc_id % 2 = 0").select("doc_id", F.array(F.lit("x"), F.lit("y")).alias("topics"))
    events = extract.events_of(docs, cores, topics)
    links = docs.select("doc_id", F.when(k % 2 == 0, k).alias("entity_id"), F.lit("voter").alias("role"), F.lit("s").alias("span"), F.lit(1.0).alias("confidence"))
    stances = docs.where("doc_id % 3 = 0").select("doc_id", k.alias("entity_id"), F.lit("x").alias("topic"), F.lit("support").alias("position"), F.lit(0.5).alias("intensity"), F.lit("s").alias("span"), F.lit(1.0).alias("confidence"))
    a = events.select("doc_id", F.lit("event").alias("kind"), F.concat_ws("|", "event_type", "what_happened", F.unix_seconds("event_time").cast("string"), "jurisdiction", F.array_join("topics", ",")).alias("value"))
    b = extract.event_sources(docs, cores).select("doc_id", F.lit("source").alias("kind"), F.concat_ws("|", "url", "trust_tier", "claim").alias("value"))
    c = extract.event_entities(links, stances).select("doc_id", F.lit("entity").alias("kind"), F.concat_ws("|", "role", "topic", F.coalesce("stance", F.lit("")), F.coalesce(F.col("intensity").cast("string"), F.lit(""))).alias("value"))
    return a.unionByName(b).unionByName(c)


@query("""
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'a,b' WHEN user_id % 3 = 1 THEN 'b,a,c' ELSE '' END AS topics, CASE WHEN user_id % 3 = 0 THEN 'b' WHEN user_id % 3 = 1 THEN 'c,b' ELSE '' END AS areas FROM events""")
def clean_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with repeats, areas that are not all among them."""
    e = table(spark, sf_dir, "events")
    lists = lambda *v: F.when(F.col("user_id") % 3 == 0, F.split(F.lit(v[0]), ",")).when(F.col("user_id") % 3 == 1, F.split(F.lit(v[1]), ",")).otherwise(F.array().cast("array<string>"))
    out = e.select("event_id", ground.clean_topics(lists("a,b,a", "b,a,b,c"), lists("z,b", "c,z,b,c")).alias("t"))
    return out.select("event_id", F.array_join("t.topics", ",").alias("topics"), F.array_join("t.policy_areas", ",").alias("areas"))


@query("""
WITH p AS (SELECT o_orderkey AS head, o_orderkey % 4 AS m FROM orders), s AS (SELECT l_orderkey AS head, l_linenumber AS n, 'flag ' || l_returnflag || ' of ' || CAST(l_quantity AS INT) AS span, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem),
q AS (SELECT head, list_distinct(list(q)) AS q, max(n) AS most, count(*) AS k, bool_or(contains(span, 'R')) AS r FROM s GROUP BY 1),
x AS (SELECT p.head, 'no citations' AS problem FROM p WHERE m = 0
 UNION SELECT p.head, 'citation ' || c FROM (SELECT head, m, unnest([1, 40]) AS c FROM p WHERE m > 0) p LEFT JOIN s ON s.head = p.head AND s.n = c WHERE s.head IS NULL
 UNION SELECT p.head, 'number ' || v FROM (SELECT head, unnest(['7', '8']) AS v FROM p WHERE m = 2) p LEFT JOIN q USING (head) WHERE NOT coalesce(list_contains(q, v), false)
 UNION SELECT p.head, 'entity R' FROM p LEFT JOIN q USING (head) WHERE m = 3 AND p.head % 5 > 0 AND NOT coalesce(r, false))
SELECT p.head, coalesce(string_agg(problem, ',' ORDER BY problem), '') AS problems FROM p LEFT JOIN x ON x.head = p.head GROUP BY p.head""")
def prose_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence on each order against its lines as spans: some cite nothing or too much, name numbers
    or an entity that may not be there."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    prose = o.select(k.alias("head"), F.when(k % 4 == 2, "about 7 and 8").when(k % 4 == 3, "R did it").otherwise("plain").alias("text"), F.when(k % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(40))).alias("cited"))
    spans = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("head"), F.col("l_linenumber").alias("n"), F.concat(F.lit("flag "), "l_returnflag", F.lit(" of "), F.col("l_quantity").cast("int").cast("string")).alias("span")).agg(F.count(F.lit(1)).alias("same")).drop("same")
    named = o.where(k % 4 == 3).select(k.alias("head"), F.lit(9).alias("entity_id"), F.lit("R").alias("surface"))
    cast = o.where(k % 5 == 0).select(k.alias("head"), F.lit(9).alias("entity_id"))
    return ground.prose_problems(prose, spans, named, cast).select("head", F.array_join("problems", ",").alias("problems"))


@query("""
SELECT l_orderkey AS head, arg_min('h' || l_linenumber, {'t': 1 + l_linenumber % 4, 'c': -(1 - l_discount), 'i': l_linenumber * 100000000 + l_suppkey}) AS headline FROM lineitem GROUP BY 1""")
def extractive_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each order's best line."""
    n = F.col("l_linenumber")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("head"), (n * 100_000_000 + F.col("l_suppkey")).alias("member_id"), F.concat(F.lit("T"), (1 + n % 4).cast("string")).alias("tier"), (1 - F.col("l_discount")).alias("confidence"), F.concat(F.lit("h"), n.cast("string")).alias("headline"), F.lit("w").alias("what_happened"))
    return ground.fallback(m).select("head", "headline")


@query("""
WITH c AS (SELECT conv_id AS answer_id, conv_id * 1000 + turn AS claim_id, turn % 3 = 0 AS bad FROM conversations),
k AS (SELECT answer_id, claim_id FROM c WHERE NOT bad AND answer_id % 4 > 0)
SELECT answer_id, claim_id, false AS refused FROM k UNION ALL SELECT DISTINCT answer_id, CAST(NULL AS BIGINT), true FROM c WHERE answer_id NOT IN (SELECT answer_id FROM k)""")
def answers_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as answers, turns as claims, each third ungrounded; each fourth is insufficient."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), "text", "turn")
    problems = c.select("claim_id", F.when(F.col("turn") % 3 == 0, "numbers").alias("problem"))
    return ground.answers(c.drop("turn"), problems, c.where("answer_id % 4 = 0").select("answer_id").distinct()).select("answer_id", "claim_id", "refused")


@query("""
WITH l AS (SELECT o_custkey AS a, l_orderkey AS c, [1.0, 0.8, 0.6, 0.4][1 + l_linenumber % 4]::DOUBLE * (1 - l_discount - l_extendedprice / 1e7) AS w, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT a, c, avg(w) AS own FROM l WHERE l_returnflag <> 'N' GROUP BY ALL), k AS (SELECT a, avg(own) AS mean, count(*) AS n FROM m GROUP BY 1), t AS (SELECT o_custkey AS a, count(*) AS claims FROM orders GROUP BY 1)
SELECT t.a AS answer_id, coalesce(round(mean * n / claims, 3), 0.0) AS confidence FROM t LEFT JOIN k ON k.a = t.a""")
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as answers, orders as claims, those with returned or accepted lines are kept."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("answer_id"))
    li = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").withColumn("n", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    records = li.select("n", F.concat(F.lit("T"), (1 + F.col("l_linenumber") % 4).cast("string")).alias("trust_tier"), (1 - F.col("l_discount") - F.col("l_extendedprice") / 1e7).alias("event_confidence"))
    kept = li.where("l_returnflag <> 'N'").select("answer_id", F.col("l_orderkey").alias("claim_id"), "n")
    return ground.answer_confidence(kept, records, o.groupBy("answer_id").agg(F.count(F.lit(1)).alias("claims")))


@query("""
WITH m AS (SELECT l_orderkey AS doc_id, CASE WHEN l_suppkey % 4 > 0 THEN l_suppkey % 3 END AS entity_id, l_linestatus AS role, 1 - l_discount AS confidence, l_linenumber AS pos FROM lineitem)
SELECT * FROM m WHERE entity_id IS NULL
UNION ALL SELECT * FROM m WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, entity_id, role ORDER BY confidence DESC, pos) = 1""")
def best_mention_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as mentions in their order, each fourth supplier unresolved."""
    s = F.col("l_suppkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(s % 4 > 0, s % 3).alias("entity_id"), F.col("l_linestatus").alias("role"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("pos"))
    return ground.best_mentions(li)
