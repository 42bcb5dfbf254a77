"""Registry lookups and minting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog import query, table
from tracewell.catalog.sources import NAMES_OF_STATES, STATE_LIST, state_of
from tracewell.operators import registry, resolve
from tracewell.params import STATES


@query(f"""
SELECT c_custkey, fips, abbrev, name AS state_name FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN {STATE_LIST}[c_custkey % {len(STATES)} + 1] END AS st FROM customer) LEFT JOIN {NAMES_OF_STATES} ON abbrev = st""")
def state_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that name a state by name, postal code or FIPS code, or no state."""
    k = F.col("c_custkey")
    name = F.regexp_replace(F.lower(state_of(k, 2)), " ", "   ")
    said = F.when(k % 4 == 0, F.concat(F.lit("  "), name, F.lit(". "))).when(k % 4 == 1, state_of(k)).when(k % 4 == 2, state_of(k, 0)).otherwise("Nowhere")
    return registry.with_states(table(spark, sf_dir, "customer").select("c_custkey", said.alias("said")), "said").drop("said")


@query("SELECT p_partkey, CASE WHEN p_size <= 25 THEN 'S' || p_size END AS series_id FROM part")
def series_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes of parts as series; those up to 25 are registered."""
    p = table(spark, sf_dir, "part").withColumn("said", F.concat(F.lit(" s"), F.col("p_size").cast("string"), F.lit(" ")))
    known = p.where("p_size <= 25").select(F.upper(F.trim("said")).alias("series_id")).distinct()
    return registry.with_series(p.select("p_partkey", "said"), "said", known).drop("said")


def members_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities: each third has a FEC id of its own, each third is a member who holds one."""
    k = F.col("s_suppkey")
    fec = F.concat(F.lit("H"), F.lpad(k.cast("string"), 8, "0"))
    ident = F.when(k % 3 == 0, F.concat(F.lit("fec:"), fec)).otherwise(F.concat(F.lit("bioguide:S"), F.lpad(k.cast("string"), 6, "0")))
    held = F.when(k % 3 == 1, F.array(fec, F.lit("S00000001"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select(k.alias("entity_id"), ident.alias("canonical_id"), held.alias("fec_ids"))


@query("""
WITH n AS (SELECT CASE WHEN count(*) > 0 THEN min(s_suppkey) END AS shared, max(s_suppkey) AS most FROM supplier WHERE s_suppkey % 3 = 1),
c AS (SELECT c_custkey, c_custkey % (SELECT count(*) + 20 FROM supplier) AS k FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN (SELECT shared FROM n) WHEN c_custkey % 7 = 1 THEN NULL WHEN k % 3 < 2 THEN s_suppkey END AS entity_id FROM c LEFT JOIN supplier ON s_suppkey = k""")
def fec_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that name candidates by FEC id: their own node, or the incumbent who holds the id."""
    n = table(spark, sf_dir, "supplier").count() + 20
    k = F.col("c_custkey")
    said = F.when(k % 7 == 0, " s00000001").when(k % 7 == 1, "h12").otherwise(F.concat(F.lit("h"), F.lpad((k % n).cast("string"), 8, "0")))
    return registry.by_fec_id(table(spark, sf_dir, "customer").select("c_custkey", said.alias("said")), "said", members_of(spark, sf_dir)).drop("said")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 AND s_suppkey % 3 > 0 THEN s_suppkey END AS entity_id FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) + 20 FROM supplier)""")
def bioguide_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that name members by id, each fifth malformed."""
    n = table(spark, sf_dir, "supplier").count() + 20
    k = F.col("c_custkey")
    said = F.when(k % 5 == 0, "S12").otherwise(F.concat(F.lit(" s"), F.lpad((k % n).cast("string"), 6, "0"), F.lit(" ")))
    return registry.by_canonical_id(table(spark, sf_dir, "customer").select("c_custkey", said.alias("said")), "said", "bioguide", members_of(spark, sf_dir)).drop("said")


TYPES = ("Politician", "Candidate", "Committee", "InterestGroup_PAC", "Agency")


@query("""
SELECT c_custkey, count(s_suppkey) AS owners FROM customer LEFT JOIN supplier ON s_suppkey % 50 = c_custkey % 50
AND (s_suppkey % 5 = c_custkey % 5 OR (c_custkey % 5 < 2 AND s_suppkey % 5 < 2) OR (c_custkey % 5 IN (2, 3) AND s_suppkey % 5 IN (2, 3))) GROUP BY 1""")
def search_scope_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of five types against suppliers as nodes of five types; how many own the name within
    the types that a mention may mean."""
    kind = lambda k: F.element_at(F.array(*map(F.lit, TYPES)), (k % 5 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("name"), kind(F.col("c_custkey")).alias("entity_type"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 50).alias("name"), kind(F.col("s_suppkey")).alias("node_type"))
    return registry.owners_in_scope(c, s, "c_custkey")


def bill_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders as bills with titles, odd ones as votes on bills."""
    k = F.col("o_orderkey")
    even = k % 2 == 0
    o = table(spark, sf_dir, "orders").select(k.alias("doc_id"), F.when(even, "bill").otherwise("vote").alias("kind"), F.lit(118).alias("congress"), F.lit("HR").alias("type"), (k % 500).alias("number"), F.concat(F.lit("HR"), (k % 700).cast("string")).alias("bill_number"), F.when(even, F.col("o_orderpriority")).alias("title"), F.concat(F.lit("u"), k.cast("string")).alias("url"))
    return registry.bill_of(o)


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 500 ELSE o_orderkey % 700 END AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS title FROM orders),
s AS (SELECT n, 'H.R. ' || n || ' (118th)' AS label, arg_min(title, doc_id) FILTER (title IS NOT NULL) AS title, arg_min('u' || doc_id, doc_id) AS url FROM d GROUP BY n)
SELECT 'bill:118-hr-' || n AS canonical_id, coalesce(label || ': ' || title, label) AS name, url, CASE WHEN n < 100 THEN 'update' ELSE 'insert' END AS change FROM s WHERE n >= 100 OR (n < 50 AND title IS NOT NULL)""")
def minted_bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bills that orders name; those below 100 are known, those below 50 by their label alone."""
    docs = bill_docs(spark, sf_dir)
    n = F.substring_index("bill_id", "-", -1).cast("int")
    label = F.concat(F.lit("H.R. "), n.cast("string"), F.lit(" (118th)"))
    known = docs.select("bill_id").distinct().where(n < 100).select(F.col("bill_id").alias("canonical_id"), F.when(n < 50, label).otherwise(F.concat(label, F.lit(": x"))).alias("name"))
    return registry.minted_bills(docs, known).select("canonical_id", "name", "url", "change")


@query("""
WITH d AS (SELECT o_orderkey AS doc_id, ['bill', 'vote', 'post'][o_orderkey % 3 + 1] AS kind, o_orderkey % (SELECT count(*) + 20 FROM supplier) AS k FROM orders),
e AS (SELECT *, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey END AS own, CASE WHEN s_suppkey % 3 < 2 THEN s_suppkey END AS fec FROM d LEFT JOIN supplier ON s_suppkey = k)
SELECT doc_id, own AS entity_id, CASE kind WHEN 'vote' THEN 'voter' WHEN 'bill' THEN 'sponsor' ELSE 'author' END AS role, CASE kind WHEN 'vote' THEN 'line one' WHEN 'bill' THEN 'Sponsor: s' || k ELSE 'Author: @h' || k END AS span FROM e WHERE own IS NOT NULL
UNION ALL SELECT doc_id, fec, 'subject', 'line one' FROM e WHERE fec IS NOT NULL
UNION ALL SELECT doc_id, CAST(7000000000 AS BIGINT), 'subject', 'line one' FROM e WHERE kind <> 'post' AND doc_id % 2 = 0""")
def connector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents that name a member and a FEC id, and bill 1 where they are even and no posts."""
    n = table(spark, sf_dir, "supplier").count() + 20
    key = F.col("o_orderkey")
    k = (key % n).cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("bill", "vote", "post"))), (key % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "orders").select(
        key.alias("doc_id"), kind.alias("kind"), F.lit("u").alias("url"), F.lit("line one\nline two").alias("body"),
        F.when(kind == "post", F.concat(F.lit("h"), k)).alias("author"), F.when(kind == "bill", F.array(F.concat(F.lit("s"), k))).otherwise(F.array().cast("array<string>")).alias("sponsors"),
        F.array(F.concat(F.lit("bioguide:S"), F.lpad(k, 6, "0")), F.concat(F.lit("fec:H"), F.lpad(k, 8, "0"))).alias("resolved"), F.when((kind != "post") & (key % 2 == 0), "bill:118-hr-1").alias("bill_id"),
    )
    bill = spark.createDataFrame([(7_000_000_000, "bill:118-hr-1", [])], "entity_id long, canonical_id string, fec_ids array<string>")
    return registry.connector_links(docs, members_of(spark, sf_dir).unionByName(bill)).select("doc_id", "entity_id", "role", "span")


@query("""
WITH c AS (SELECT s_suppkey, string_agg(e || '=' || (e * 7 + s_suppkey) % 5, ',' ORDER BY (e * 7 + s_suppkey) % 5 DESC, e) AS cand FROM (SELECT s_suppkey, unnest(range(1, s_suppkey % 4 + 1)) AS e FROM supplier) GROUP BY 1)
SELECT l_orderkey AS doc_id, 'm' || l_suppkey AS mention, coalesce(cand, '') AS candidates, '{"role":"actor","span":"s' || l_suppkey || '"}' AS payload FROM lineitem LEFT JOIN c ON s_suppkey = l_suppkey WHERE l_returnflag <> 'A'""")
def unresolved_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as mentions of suppliers, those of flag A resolved; up to three scored candidates each."""
    s = F.col("l_suppkey")
    links = table(spark, sf_dir, "lineitem").select(s.alias("mention_id"), F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("m"), s.cast("string")).alias("mention"), F.lit("Agency").alias("entity_type"), F.lit("actor").alias("role"), F.concat(F.lit("s"), s.cast("string")).alias("span"), F.col("l_discount").alias("confidence"), F.when(F.col("l_returnflag") == "A", s).alias("entity_id"))
    k, e = F.col("s_suppkey"), F.col("e")
    found = table(spark, sf_dir, "supplier").where("s_suppkey % 4 > 0").select("s_suppkey", F.explode(F.sequence(F.lit(1).cast("long"), k % 4)).alias("e")).select(k.alias("mention_id"), e.alias("entity_id"), ((e * 7 + k) % 5).cast("double").alias("score"))
    out = registry.unresolved_review(links, found)
    told = F.transform("candidates", lambda x: F.concat_ws("=", x["entity_id"].cast("string"), x["score"].cast("int").cast("string")))
    return out.select("doc_id", "mention", F.array_join(told, ",").alias("candidates"), "payload")


@query("""
WITH r AS (SELECT s_suppkey AS k, CASE s_suppkey % 4 WHEN 0 THEN ' ' || s_suppkey WHEN 1 THEN 'Supp:' || s_suppkey WHEN 2 THEN upper(s_name) ELSE 'nobody ' || s_suppkey END AS ref FROM supplier)
SELECT ref, CASE WHEN k % 4 < 3 THEN k END AS entity_id, ['number', 'canonical', 'name', 'none'][k % 4 + 1] AS how FROM r""")
def entity_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers named by number, canonical id or name, or not at all."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    entities = s.select(k.alias("entity_id"), F.concat(F.lit("supp:"), k.cast("string")).alias("canonical_id"), F.col("s_name").alias("name"), F.array().cast("array<string>").alias("aliases"))
    said = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("Supp:"), k.cast("string"))).when(k % 4 == 2, F.upper("s_name")).otherwise(F.concat(F.lit("nobody "), k.cast("string")))
    return resolve.entity_refs(s.select(said.alias("ref")), entities)


@query("""
WITH e AS (SELECT event_id AS k FROM events), races AS (SELECT DISTINCT 'R' || n_nationkey || '-SEN-' || y AS race_id, y, n_nationkey AS n FROM nation, (VALUES (2024), (2026)) v(y) WHERE n_nationkey % 2 = 0 OR y = 2024),
r AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'e' || (k + 5) ELSE ' r' || (k % 30) || CASE WHEN k % 3 = 0 THEN '-sen' WHEN k % 3 = 1 THEN '-SEN-2024' ELSE '' END END AS ref FROM e)
SELECT ref, CASE WHEN k % 2 = 0 THEN CAST(f.event_id AS VARCHAR) ELSE (SELECT arg_max(race_id, y) FROM races WHERE n = k % 30 AND (k % 3 <> 1 OR y = 2024)) END AS target FROM r LEFT JOIN events f ON k % 2 = 0 AND f.event_id = k + 5""")
def event_and_race_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events named by number, some unknown; races by their start or whole, the newest cycle counts."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id")
    heads = resolve.event_refs(e.where(k % 2 == 0).select(F.concat(F.lit("e"), (k + 5).cast("string")).alias("ref")), e.select(k.alias("head")))
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n"), F.explode(F.array(F.lit(2024), F.lit(2026))).alias("cycle")).where("n % 2 = 0 or cycle = 2024")
    races = nations.select(F.concat(F.lit("R"), F.col("n").cast("string"), F.lit("-SEN-"), F.col("cycle").cast("string")).alias("race_id"), "cycle")
    end = F.when(k % 3 == 0, "-sen").when(k % 3 == 1, "-SEN-2024").otherwise("")
    named = resolve.race_refs(e.where(k % 2 == 1).select(F.concat(F.lit(" r"), (k % 30).cast("string"), end).alias("ref")), races)
    return heads.select("ref", F.col("head").cast("string").alias("target")).unionByName(named.select("ref", F.col("race_id").alias("target")))
