"""Payload scans (S1, S3-S16) and sinks (D3, D4, D9, D11-D13, D16) on payloads that Spark renders from the
driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog import query, table
from tracewell.operators import extract, rows
from tracewell.params import LOOKBACK_DAYS, STATES
from tracewell.sources import scans
from tracewell.streaming.ingest import new_folder

STATE_LIST = "[" + ", ".join(f"'{a}'" for _, a, _ in STATES) + "]"


def shared(spark: SparkSession) -> str:
    from tracewell.queries import shared as folder

    return folder(spark)


def state_of(n, part: int = 1):
    """The postal code (or another part) of the n-th state."""
    return F.element_at(F.array(*[F.lit(s[part]) for s in STATES]), (F.pmod(n, F.lit(len(STATES))) + 1).cast("int"))


@query("""
WITH p AS (SELECT page_id, url, list_sort(list_distinct(['k:' || page_id % 7, 'k:' || page_id % 5])) AS r, list_sort(list_distinct(CASE WHEN page_id % 3 = 0 THEN ['x'] ELSE [] END)) AS u FROM pages)
SELECT page_id, url, array_to_string(r, ',') AS resolved, array_to_string(u, ',') AS unresolved FROM p WHERE url <> ''""")
def raw_record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as raw records with ids that repeat."""
    p = table(spark, sf_dir, "pages").select("url", F.col("html").alias("text"), F.col("page_id").cast("string").alias("raw_payload"), F.array(F.concat(F.lit("k:"), (F.col("page_id") % 7).cast("string")), F.concat(F.lit("k:"), (F.col("page_id") % 5).cast("string")), F.lit(None)).alias("entity_ids"), F.when(F.col("page_id") % 3 == 0, F.array(F.lit("x"), F.lit("x"))).alias("unresolved"))
    out = rows.raw_rows(scans.raw_records(p))
    return out.select(F.col("raw_payload").cast("long").alias("page_id"), "url", F.array_join("resolved", ",").alias("resolved"), F.array_join("unresolved", ",").alias("unresolved"))


@query("""
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'A' ELSE 'B' END AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS "asof", CAST(sum(CAST(o_totalprice AS DECIMAL(20, 2))) AS DOUBLE) AS value
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND month(o_orderdate) % 4 <> 0 GROUP BY 1, 2""")
def releases_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: monthly totals of orders by priority as a release of series; each fourth month is '-', a yearly
    row M13 comes along, and only two series are mapped."""
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("seriesID"), F.year("o_orderdate").cast("string").alias("year"), F.month("o_orderdate").alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("total"))
    row = F.struct("year", F.concat(F.lit("M"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("period"), F.when(F.col("m") % 4 == 0, "-").otherwise(F.col("total").cast("string")).alias("value"))
    data = F.collect_list(row)
    series = m.groupBy("seriesID").agg(F.concat(data, F.array(F.struct(F.lit("1996").alias("year"), F.lit("M13").alias("period"), F.lit("1").alias("value")))).alias("data"))
    payload = F.to_json(F.struct(F.lit("REQUEST_SUCCEEDED").alias("status"), F.struct(F.array(F.struct("seriesID", "data")).alias("series")).alias("Results")))
    found = scans.releases(series.select(payload.alias("payload")), {"1-URGENT": "A", "2-HIGH": "B"})
    return found.withColumn("value", F.col("value").cast("double"))


@query("""
WITH b AS (SELECT *, 100 + o_orderkey // 100000 AS c, ['s', 'hr', 'sres', 'hres'][o_orderkey % 4 + 1] AS k, o_orderkey % 100000 AS n FROM orders ORDER BY CAST(o_orderdate AS DATE) DESC, c, upper(k), CAST(n AS VARCHAR) LIMIT 20)
SELECT 'bill:' || c || '-' || k || '-' || n AS bill_id, (CASE k WHEN 's' THEN 'S.' WHEN 'hr' THEN 'H.R.' ELSE upper(k) END) || ' ' || n || ' (' || c || 'th): ' || o_orderpriority || chr(10) || 'Latest action: ' || o_orderstatus AS text,
  date_trunc('day', o_orderdate) AS event_time, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS entity_ids,
  CASE WHEN o_custkey % 2 = 0 THEN 'Z000001' ELSE 'C' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || ',Z000001' END AS unresolved FROM b""")
def bills_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bills with two sponsors, of which customers with even keys are known; the newest 20."""
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, ("S", "HR", "SRES", "HRES"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    sponsor = lambda b: F.struct(b.alias("bioguideId"), F.lit("n").alias("fullName"), F.lit("D").alias("party"), F.lit("GA").alias("state"))
    who = F.array(sponsor(F.concat(F.lit("C"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"))), sponsor(F.lit("Z000001")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    payload = F.to_json(F.struct((100 + F.expr("o_orderkey div 100000")).cast("int").alias("congress"), kind.alias("type"), (F.col("o_orderkey") % 100000).cast("string").alias("number"), F.col("o_orderpriority").alias("title"), day.alias("updateDate"), F.struct(day.alias("actionDate"), F.col("o_orderstatus").alias("text")).alias("latestAction"), who.alias("sponsors")))
    known = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("bioguide_id"), F.col("c_custkey").cast("string").alias("entity_id"))
    return scans.bills(o.select(payload.alias("payload")), known).withColumns({"entity_ids": F.array_join("entity_ids", ","), "unresolved": F.array_join("unresolved", ",")})


@query("""
SELECT o_orderkey AS rollnumber, 'RS' || ((year(o_orderdate) - 1789) // 2 + 1) || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INT), '0') AS roll_id
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' ORDER BY o_orderkey DESC LIMIT 20""")
def roll_call_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as roll calls since 1996; the newest 20."""
    return scans.roll_call_index(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rollnumber"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")), "1996-01-01")


@query("""
WITH v AS (SELECT l_orderkey, list_sort(list('S' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') || ':' || CASE l_returnflag WHEN 'R' THEN 'Nay' WHEN 'A' THEN 'Yea' ELSE 'Not Voting' END || ':' || CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE '' END)) AS m FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN year(o_orderdate) % 2 = 1 THEN 1 ELSE 2 END AS session, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS clerk, CASE WHEN o_orderkey % 2 = 0 THEN 'bill:118-hr-' || o_orderkey % 1000 END AS bill_id, o_orderstatus AS vote_result, array_to_string(m, ',') AS members
FROM orders LEFT JOIN v ON l_orderkey = o_orderkey""")
def roll_calls_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as roll calls, lines as votes of suppliers, of whom even ones are known; odd orders
    are on nominations."""
    li = table(spark, sf_dir, "lineitem")
    member = lambda c: F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 6, "0"))
    cast = F.when(F.col("l_returnflag") == "R", "Nay").when(F.col("l_returnflag") == "A", "Yea").otherwise("Not Voting")
    votes = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(member("l_suppkey").alias("bioguide_id"), cast.alias("cast_str"))).alias("votes"))
    o = table(spark, sf_dir, "orders").join(votes, "o_orderkey", "left")
    number = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("HR"), (F.col("o_orderkey") % 1000).cast("string"))).otherwise("PN12")
    payload = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit(118).alias("congress"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderkey") % 100000).cast("int").alias("clerk_rollnumber"), number.alias("bill_number"), F.col("o_orderstatus").alias("vote_result"), "votes"))
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(member("s_suppkey").alias("bioguide_id"), F.col("s_suppkey").cast("string").alias("entity_id"))
    said = lambda m: F.concat_ws(":", m["bioguide_id"], m["cast_str"], F.coalesce(m["entity_id"], F.lit("")))
    return scans.roll_calls(o.select(payload.alias("payload")), known).select("id", "session", "clerk", "bill_id", "vote_result", F.array_join(F.array_sort(F.transform("members", said)), ",").alias("members"))


CANDIDATES = "(SELECT c_custkey, c_name, c_nationkey, c_acctbal, 'H' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id FROM customer WHERE c_acctbal > 0 AND c_custkey % 11 <> 0)"


def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    ident = F.concat(F.when(F.col("c_custkey") % 11 == 0, "X").otherwise("H"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    return scans.candidates(c.select(ident.alias("candidate_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("race_id"), F.when(F.col("c_custkey") % 5 == 0, "I").otherwise("C").alias("incumbent_challenge"), F.col("c_acctbal").cast("decimal(18,2)").alias("receipts"), F.lit(0).cast("decimal(18,2)").alias("disbursements"), F.lit(1).cast("decimal(18,2)").alias("cash_on_hand_end_period"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 100).cast("int")).alias("coverage_end_date")))


@query(f"""
SELECT id AS candidate_id, CASE WHEN c_custkey % 5 = 0 THEN 'incumbent' ELSE 'candidate' END AS role, c_name || ' raised $' || format('{{:,}}', CAST(round_even(c_acctbal, 0) AS BIGINT)) AS text FROM {CANDIDATES}""")
def candidates_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates with their balance as receipts; each eleventh id is malformed."""
    return candidate_rows(spark, sf_dir).select("candidate_id", "role", "text")


@query(f"""
SELECT c_nationkey AS race_id, string_agg(id, ',' ORDER BY id) AS candidate_ids, max(DATE '2024-01-01' + CAST(c_custkey % 100 AS INT)) AS "asof", count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18, 2))) AS DOUBLE) AS receipts FROM {CANDIDATES} GROUP BY 1""")
def finance_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of each nation."""
    out = scans.finance_by_race(candidate_rows(spark, sf_dir))
    total = F.aggregate(F.map_values("finance"), F.lit(0).cast("decimal(38,2)"), lambda s, v: (s + v["receipts"]).cast("decimal(38,2)"))
    return out.select("race_id", F.array_join("candidate_ids", ",").alias("candidate_ids"), "asof", F.size("finance").cast("long").alias("n"), total.cast("double").alias("receipts"))


@query("""
SELECT 'https://x.com/h' || conv_id || '/status/' || turn AS url, text, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN conv_id END AS entity_id, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 1 THEN '@h' || conv_id END AS unresolved, conv_id % 3 <> 0 AS has_kind FROM conversations""")
def posts_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as accounts, each third a member's, of whom even ones are known; turns as posts.
    The author's kind is in the payload only where it is not the default."""
    c = table(spark, sf_dir, "conversations")
    data = c.groupBy(F.col("conv_id").alias("user_id")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("turn").cast("string").alias("id"), "text", F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.lit("en").alias("lang"))).alias("data"))).alias("payload"))
    n = F.col("conv_id")
    bioguide = F.concat(F.lit("B"), F.lpad(n.cast("string"), 6, "0"))
    accounts = c.select("conv_id").distinct().select(n.alias("user_id"), F.concat(F.lit("h"), n.cast("string")).alias("handle"), F.when(n % 3 == 0, "member").otherwise("media").alias("kind"), F.when(n % 3 == 0, bioguide).alias("bioguide"))
    known = c.where("conv_id % 2 = 0").select(bioguide.alias("bioguide_id"), n.alias("entity_id")).distinct()
    return scans.posts(data, accounts, known).select("url", "text", "entity_id", "unresolved", F.get_json_object("raw_payload", "$.author.kind").isNotNull().alias("has_kind"))


@query(f"""
WITH c AS (SELECT {STATE_LIST}[c_custkey % {len(STATES)} + 1] AS st, CASE c_mktsegment WHEN 'BUILDING' THEN 'safe_d' WHEN 'MACHINERY' THEN 'tossup' WHEN 'FURNITURE' THEN 'lean_r' WHEN 'HOUSEHOLD' THEN 'safe_r' END AS rating FROM customer)
SELECT st || '-SEN-2026' AS race_id, rating, count(*) AS n FROM c WHERE rating IS NOT NULL AND st < 'N' GROUP BY ALL""")
def rating_cards_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rating cards of one state each, on one page per nation; states are named by
    postal code or name; one label is unknown; only states before N have a race."""
    label = F.when(F.col("c_mktsegment") == "BUILDING", "Solid Democrat").when(F.col("c_mktsegment") == "MACHINERY", "TOSS UP (1)").when(F.col("c_mktsegment") == "FURNITURE", "Lean <b>Republican</b>").when(F.col("c_mktsegment") == "HOUSEHOLD", "Solid Republican").otherwise("Unclear")
    state = F.when(F.col("c_custkey") % 2 == 0, state_of(F.col("c_custkey"))).otherwise(state_of(F.col("c_custkey"), 2))
    card = F.concat(F.lit('<div class="race-card wide"><div class="race-card-header">'), label, F.lit('</div><span class="race-district"> '), state, F.lit(" </span></div>"))
    pages = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.concat_ws("\n", F.collect_list(card)).alias("html")).withColumn("fetched", F.lit("2026-01-01").cast("date"))
    races = spark.createDataFrame([(f"{a}-SEN-2026",) for _, a, _ in STATES if a < "N"], "race_id string")
    return scans.keyed_ratings(scans.rating_cards(pages), races, 2026).groupBy("race_id", "rating").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
SELECT {STATE_LIST}[s_suppkey % {len(STATES)} + 1] AS state, CASE s_suppkey % 4 WHEN 0 THEN 'safe_d' WHEN 1 THEN 'tossup_d' WHEN 2 THEN 'tossup' END AS rating, DATE '2026-02-01' + CAST(s_suppkey % 28 AS INT) AS "asof" FROM supplier WHERE s_suppkey % 4 < 3""")
def rating_feed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of a rating feed; each fourth label is unknown."""
    label = F.element_at(F.array(*map(F.lit, (" Solid Democrat", "TILT democrat", "Toss-Up ", "???"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    row = F.struct(F.lower(state_of(F.col("s_suppkey"))).alias("district"), label.alias("rating"), F.date_format(F.date_add(F.lit("2026-02-01").cast("date"), (F.col("s_suppkey") % 28).cast("int")), "yyyy-MM-dd").alias("date"))
    payloads = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(row).alias("ratings"))).alias("payload"))
    return scans.rating_feed(payloads)


SENATORS = f"(SELECT c_custkey, 'C' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS id, 'F' || c_custkey % 10 AS first, 'L' || c_custkey AS last, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_custkey % 7 END AS nick, {STATE_LIST}[c_custkey % {len(STATES)} + 1] AS st, CAST(c_custkey % 3 + 1 AS INT) AS class, CASE c_custkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'R' ELSE 'I' END AS party, CASE WHEN c_custkey % 4 = 0 THEN 'h' || c_custkey END AS handle, CASE WHEN c_custkey % 5 = 0 THEN 'S' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS fec FROM customer WHERE c_custkey % 2 = 0)"


def senator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as legislators, even ones in the Senate at last."""
    k = F.col("c_custkey")
    text = k.cast("string")
    term = lambda kind: F.struct(kind.alias("type"), state_of(k).alias("state"), (k % 3 + 1).cast("int").alias("class"), F.element_at(F.array(*map(F.lit, ("Democrat", "Republican", "Independent"))), (k % 3 + 1).cast("int")).alias("party"), F.lit("2020-01-01").alias("start"), F.lit("2026-01-01").alias("end"))
    fec = F.when(k % 5 == 0, F.array(F.concat(F.lit("S"), F.lpad(text, 8, "0")))).otherwise(F.array().cast("array<string>"))
    names = F.struct(F.concat(F.lit("F"), (k % 10).cast("string")).alias("first"), F.concat(F.lit("L"), text).alias("last"), F.when(k % 3 == 0, F.concat(F.lit("N"), (k % 7).cast("string"))).alias("nickname"), F.when(k % 2 == 0, F.lit(None)).cast("string").alias("official_full"))
    bioguide = F.concat(F.lit("C"), F.lpad(text, 6, "0"))
    payload = F.to_json(F.struct(F.struct(bioguide.alias("bioguide"), fec.alias("fec")).alias("id"), names.alias("name"), F.array(term(F.lit("sen")), term(F.when(k % 2 == 0, "sen").otherwise("rep"))).alias("terms")))
    c = table(spark, sf_dir, "customer")
    legislators = c.select(F.from_json(payload, scans.LEGISLATORS).alias("p")).select("p.*")
    social = c.where("c_custkey % 4 = 0").select(bioguide.alias("bioguide_id"), F.concat(F.lit("h"), text).alias("handle"))
    return scans.senators(legislators, social)


@query(f"""
SELECT 'bioguide:' || id AS canonical_id, first || ' ' || last AS name, st AS state, class, party,
  array_to_string(list_filter([first || ' ' || last, nick || ' ' || last, last, last || ' (' || party || '-' || st || ')', first || ' ' || last || ' (' || party || '-' || st || ')', '@' || handle, fec], lambda x: x IS NOT NULL), '|') AS aliases FROM {SENATORS}""")
def senators_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senators with all names that they go by."""
    s = senator_rows(spark, sf_dir)
    return scans.politician_entities(s).join(s.select(F.concat(F.lit("bioguide:"), "bioguide_id").alias("canonical_id"), "state", "class", "party"), "canonical_id").select("canonical_id", "name", "state", "class", "party", F.array_join("aliases", "|").alias("aliases"))


NAMES_OF_STATES = "(VALUES " + ", ".join(f"('{f}', '{a}', '{n}')" for f, a, n in STATES) + ") s(fips, abbrev, name)"


@query(f"""
WITH r AS (SELECT *, {STATE_LIST}[s_suppkey % {len(STATES)} + 1] AS st, CAST(s_suppkey % 3 + 1 AS INT) AS class FROM supplier),
i AS (SELECT st, class, min(id) AS incumbent FROM {SENATORS} GROUP BY ALL)
SELECT s_suppkey, 'race:' || r.st || '-SEN-2026' AS canonical_id, s.fips AS fips, incumbent, s.name || ' Senate' || CASE WHEN s_suppkey % 4 = 0 THEN ' Special' ELSE '' END || ' 2026' AS name
FROM r JOIN {NAMES_OF_STATES} ON s.abbrev = r.st LEFT JOIN i ON i.st = r.st AND i.class = r.class""")
def race_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as seats, with their incumbents and entities."""
    k = F.col("s_suppkey")
    seats = table(spark, sf_dir, "supplier").select("s_suppkey", state_of(k).alias("state"), (k % 3 + 1).cast("int").alias("class"), (k % 4 == 0).alias("special"))
    races = scans.race_table(seats, senator_rows(spark, sf_dir).select("bioguide_id", "state", "class"), 2026)
    named = scans.race_entities(races.select("race_id", "state_name", "special", "cycle").distinct()).select("canonical_id", "name")
    special = named.select("canonical_id", "name", F.contains("name", F.lit(" Special ")).alias("special"))
    return races.withColumn("canonical_id", F.concat(F.lit("race:"), "race_id")).join(special, ["canonical_id", "special"]).select("s_suppkey", "canonical_id", "fips", "incumbent", "name")


@query(f"""
SELECT p_partkey AS series_id, DATE '2024-06-30' - CAST(CASE p_size % 6 {' '.join(f"WHEN {i} THEN {d}" for i, d in enumerate(LOOKBACK_DAYS.values()))} ELSE 180 END AS INT) AS since FROM part""")
def lookback_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as series, their size as frequency."""
    names = F.array(*map(F.lit, [*LOOKBACK_DAYS, "irregular"]))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("series_id"), F.element_at(names, (F.col("p_size") % 6 + 1).cast("int")).alias("frequency"))
    return scans.lookback(p, F.lit("2024-06-30").cast("date")).select("series_id", "since")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS race_id, arg_max(CAST(o_totalprice AS DOUBLE), {'d': CAST(o_orderdate AS DATE), 'h': CAST(o_orderkey AS VARCHAR)}) AS value, max(CAST(o_orderdate AS DATE)) AS "asof" FROM orders GROUP BY 1""")
def latest_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed as polls of their customers; the newest of each."""
    path = new_folder(shared(spark), "polls")
    o = table(spark, sf_dir, "orders")
    o.select(F.col("o_custkey").cast("string").alias("race_id"), F.col("o_totalprice").cast("decimal(20,6)").alias("value"), F.to_date("o_orderdate").alias("asof"), F.lit("u").alias("source_url"), F.col("o_orderkey").cast("string").alias("content_hash")).write.parquet(path)
    newest = rows.first_per_key(scans.polls(spark, path), ["race_id"], F.desc("asof"), F.desc("content_hash"))
    return newest.select("race_id", F.col("value").cast("double").alias("value"), "asof")


# ------------------------------------------------------------------ sinks


@query("SELECT event_type AS source, CAST(ts AS DATE) AS event_date, count(*) AS n FROM events GROUP BY ALL")
def archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events archived as JSON by kind and day, twice, and read back."""
    path = new_folder(shared(spark), "archive")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.to_date("ts").alias("event_date"), "event_id", "value")
    rows.archive(e, path)
    rows.archive(e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1")), path)
    back = spark.read.schema("source string, event_date date, event_id long, value double, yyyy int, mm int, dd int").json(path)
    return back.groupBy("source", "event_date").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'EXTRACTED' END AS status, 0 AS attempt FROM orders WHERE o_orderkey % 2 = 0),
a AS (SELECT l_orderkey AS item_id, l_linenumber AS attempt, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'DROPPED' END AS status FROM lineitem),
n AS (SELECT item_id, arg_max(status, attempt) AS status, max(attempt) AS attempt FROM (SELECT item_id, attempt, min(status) AS status FROM a GROUP BY ALL) WHERE item_id NOT IN (SELECT item_id FROM l WHERE status <> 'FAILED') GROUP BY 1)
SELECT item_id, attempt, status FROM n UNION ALL SELECT item_id, attempt, status FROM l WHERE item_id NOT IN (SELECT item_id FROM n)""")
def ledger_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders in the ledger, each third failed; lines as attempts, the last of each order counts."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0")
    ledger = o.select(F.col("o_orderkey").alias("item_id"), F.lit(0).alias("attempt"), F.when(F.col("o_orderkey") % 3 == 0, "FAILED").otherwise("EXTRACTED").alias("status"))
    tried = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("attempt")).agg(F.min(F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("DROPPED")).alias("status"))
    return extract.run_ledger(ledger, tried)


@query("""
WITH i AS (SELECT l_orderkey AS doc_id, l_returnflag AS kind, 'm' || l_suppkey % 3 AS mention, l_linestatus AS field, l_linenumber, l_extendedprice FROM lineitem),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, mention, field ORDER BY l_linenumber, l_extendedprice) AS r FROM i) WHERE r = 1)
SELECT doc_id, kind, mention, field, l_linenumber FROM f WHERE (doc_id, kind, mention, field) NOT IN (SELECT doc_id, kind, mention, field FROM i WHERE doc_id % 2 = 0 AND kind = 'N')""")
def review_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as review rows; those of even orders with flag N are stored."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("kind"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("mention"), F.col("l_linestatus").alias("field"), "l_linenumber", "l_extendedprice")
    found = extract.review_inserts(li.where("doc_id % 2 = 0 and kind = 'N'"), li, F.col("l_linenumber"), F.col("l_extendedprice"))
    return found.select("doc_id", "kind", "mention", "field", "l_linenumber")


@query("""
SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price FROM orders WHERE o_custkey % 3 <> 0 OR o_orderstatus = 'F'""")
def rebuild_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers divisible by 3 are refreshed to their closed orders at another price; twice."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    fresh = o.where("o_orderstatus = 'F'").withColumn("price", F.col("price") + 1).drop("o_orderstatus")
    mine = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    once = rows.rebuilt(o.drop("o_orderstatus"), fresh, "o_custkey", mine)
    return rows.rebuilt(once, fresh, "o_custkey", mine)


@query("""
WITH h AS (SELECT l_orderkey, sha256('1:' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber)) AS member_hash FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1),
s AS (SELECT l_orderkey, sha256('1:' || string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber)) AS had FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1)
SELECT h.l_orderkey, member_hash FROM h LEFT JOIN s ON s.l_orderkey = h.l_orderkey WHERE had IS DISTINCT FROM member_hash""")
def stale_head_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines differ from those without returns, which are stored."""
    li = table(spark, sf_dir, "lineitem")
    hashes = lambda x: rows.membership_hash(x.select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")
    return rows.stale_heads(hashes(li), hashes(li.where("l_returnflag <> 'R'")), "l_orderkey")


@query("""
SELECT event_type, count(*) AS fetched, count(*) FILTER (event_id % 7 <> 0 AND user_id % 2 = 1) AS inserted, count(*) FILTER (event_id % 7 <> 0 AND user_id % 2 = 0) AS skipped, count(*) FILTER (event_id % 7 = 0) AS failed FROM events GROUP BY 1""")
def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose props are cut short for each seventh; those of even users are known."""
    e = table(spark, sf_dir, "events").withColumn("props", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")))
    return extract.batch_counts(e, "event_type", F.when(F.try_parse_json("props").isNull(), "malformed"), F.col("user_id") % 2 == 0)


@query("""
SELECT 'fred:P' || p_partkey AS canonical_id, p_name AS name, 'EconomicIndicator' AS entity_type, array_to_string(CASE WHEN p_partkey % 3 > 0 THEN ['P' || p_partkey, p_name] ELSE ['P' || p_partkey, p_name, p_type] END, '|') AS aliases FROM part""")
def indicator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as series; each third has an alias of its own and one that repeats its title."""
    k = F.col("p_partkey")
    series = table(spark, sf_dir, "part").select(F.concat(F.lit("P"), k.cast("string")).alias("series_id"), F.col("p_name").alias("title"), F.when(k % 3 == 0, F.array("p_type", "p_name")).alias("aliases"))
    return scans.indicator_entities(series).select("canonical_id", "name", "entity_type", F.array_join("aliases", "|").alias("aliases"))


@query(f"""
WITH s AS (SELECT unnest({[f for f, _, _ in STATES]}) AS fips, unnest({[a for _, a, _ in STATES]}) AS abbrev, unnest({[n for _, _, n in STATES]}) AS name)
SELECT 'fips:' || fips AS canonical_id, name, count(*) AS n FROM customer JOIN s ON abbrev = {STATE_LIST}[c_custkey % {len(STATES)} + 1] GROUP BY ALL""")
def jurisdiction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the jurisdictions that their states name, by postal code or name."""
    k = F.col("c_custkey")
    named = table(spark, sf_dir, "customer").select(F.when(k % 2 == 0, state_of(k)).otherwise(state_of(k, 2)).alias("alias"))
    places = scans.jurisdiction_entities(spark).select("canonical_id", "name", F.explode("aliases").alias("alias"))
    return named.join(places, "alias").groupBy("canonical_id", "name").agg(F.count(F.lit(1)).alias("n"))
