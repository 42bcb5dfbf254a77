"""The engine's operators applied to the driver's tables.  Roles of columns are noted in each query;
all read whole tables."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import claims as claim
from tracewell.functions.columns import epoch_us, independence_key, lookup, make_id, number_set, split_id
from tracewell.operators import cluster, graph, ground, resolve, rows, verify
from tracewell.params import STATUS_BONUS
from tracewell.plans import views
from tracewell.sources import scans
from tracewell.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, a session on one
    machine (tests) gets a temporary folder; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/tracewell-{spark.sparkContext.applicationId}"
    return where.rstrip("/")


def k_of(props: str = "props"):
    return F.get_json_object(props, "$.k").cast("int")


# ------------------------------------------------------------------ feed and rows


@query
def feed_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are heads; sources are the kinds of event of that user on that day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    # Only the window's days count, and the scan is cut to them.
    near = e.where((F.col("ts") >= "2024-01-17") & (F.col("ts") <= "2024-01-31"))
    kinds = near.groupBy("user_id", "day").agg(F.countDistinct("event_type").alias("sources"))
    status = lookup({"purchase": "fact_checked", "signup": "corroborated", "click": "single_source", "view": "unverified", "error": "contradicted"}, F.col("event_type"))
    stored = F.least(F.col("value") / 100, F.lit(1.0))
    prior = lookup({"purchase": 1.0, "signup": 0.6, "click": 0.5}, F.col("event_type"), 0.4)
    heads = near.join(kinds, ["user_id", "day"]).select(F.col("event_id").alias("head"), F.col("event_type").alias("kind"), "ts", "sources", F.when(stored > 0, stored).otherwise(prior).alias("importance"), lookup(STATUS_BONUS, status).alias("bonus"), (k_of() / 100).alias("link_confidence"), F.lit(2024).alias("cycle"))
    return views.feed(heads, "2024-01-31 00:00:00")


@query
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by (source, lang as url, text); what is stored are documents divisible by 3."""
    d = table(spark, sf_dir, "documents").withColumn("content_hash", rows.content_hash(F.col("source"), F.col("lang"), F.col("text"))).select("doc_id", "content_hash")
    return rows.new_rows(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0"), "content_hash", F.col("doc_id"))


@query
def change_detecting_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders are stored, all come in, each tenth with another price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = o.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rows.changed_rows(o.where("o_orderkey % 2 = 0"), new, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a returned line."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return rows.pending(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey", F.col("l_returnflag") == "R")


@query
def daily_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three orders a day less those in status F."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate"))
    used = o.where("o_orderstatus = 'F'").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return rows.capped(o.where("o_orderstatus <> 'F'").select("o_orderkey", "day"), "day", used, 3, F.col("o_orderkey"))


@query
def latest_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order per customer, then by priority."""
    o = table(spark, sf_dir, "orders")
    return rows.first_per_key(o, ["o_custkey"], F.desc("o_orderdate"), F.col("o_orderpriority"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query
def keep_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest line per order and part."""
    li = table(spark, sf_dir, "lineitem")
    return rows.first_per_key(li, ["l_orderkey", "l_partkey"], F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_suppkey")).select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query
def membership_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each order's lines."""
    return rows.membership_hash(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector of model m1 (labels below 5 stand for it)."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, "m1").otherwise("m0").alias("model"))
    return rows.stale_vectors(table(spark, sf_dir, "documents").select("doc_id"), v, "doc_id", "m1").select("doc_id")


@query
def integrity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a constraint, by constraint."""
    o, li, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    checks = {
        "discount_range": li.where(~F.col("l_discount").between(0, 0.05)),
        "line_order_known": li.join(o, li["l_orderkey"] == o["o_orderkey"], "left_anti"),
        "order_customer_known": o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti"),
        "line_key_unique": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "status_known": o.where(~F.col("o_orderstatus").isin("F", "O")),
    }
    return rows.violations(checks)


# ------------------------------------------------------------------ sources and ids


@query
def observations_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's k as an observation of its day; each tenth is missing."""
    value = F.when(k_of() % 10 == 0, F.lit(".")).otherwise(k_of().cast("string"))
    payload = F.to_json(F.struct(F.array(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations")))
    found = scans.observations(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("series_id"), payload.alias("payload")))
    return found.select(F.col("series_id").cast("long").alias("event_id"), "asof", F.col("value").cast("double").alias("value"))


@query
def canonical_id_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made of customers' numbers and split again."""
    n = F.regexp_extract("c_name", "([0-9]+)$", 1)
    made = table(spark, sf_dir, "customer").select(
        "c_custkey",
        make_id("bioguide", F.concat(F.substring("c_mktsegment", 1, 1), F.substring(n, 4, 6))).alias("bioguide"),
        make_id("fips", F.substring(n, -2, 2)).alias("fips"),
        make_id("bill", F.concat(F.lit("119-"), F.lower(F.substring("c_mktsegment", 1, 1)), F.lit("-"), F.col("c_custkey").cast("string"))).alias("bill"),
        make_id("race", F.upper(F.col("c_name"))).alias("race"),
    )
    back = split_id(F.col("bioguide"))
    return made.select("*", back["namespace"].alias("namespace"), back["raw"].alias("raw"))


def entities_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("entity_id"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 2_000_000_000).cast("long").alias("entity_id"), F.col("s_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("entity_id"), F.col("p_name").alias("name"))
    return n.unionByName(s).unionByName(p).withColumn("aliases", F.array().cast("array<string>"))


@query
def alias_exact_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy mentions of suppliers and parts; parts' names have several owners."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("mention_id"), F.concat(F.lit("Sen. "), F.upper("s_name"), F.lit(" (R-FL)")).alias("mention"))
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000).alias("mention_id"), F.concat(F.lit(" @"), F.initcap("p_name"), F.lit(" Jr")).alias("mention"))
    return resolve.exact_resolve(s.unionByName(p), resolve.alias_index(entities_of(spark, sf_dir)))


@query
def alias_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several owners."""
    return resolve.ambiguous_aliases(resolve.alias_index(entities_of(spark, sf_dir)))


@query
def alias_fuzzy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their third letter lost, against the distinct names (owner: least key)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    owners = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id")).withColumn("aliases", F.array().cast("array<string>"))
    # Mentions repeat; each distinct one is resolved once.
    mentions = p.select(F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)")).alias("mention"), "p_partkey")
    each = mentions.groupBy("mention").agg(F.min("p_partkey").alias("mention_id"))
    done = resolve.fuzzy_resolve(each, resolve.alias_index(owners)).select("mention", "entity_id", "confidence")
    return mentions.join(done, "mention").select("p_partkey", "mention", "entity_id", "confidence")


@query
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with another first letter and without their third, which start like no name, with the five
    best of all distinct names (owner: least key)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    owners = p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("entity_id")).withColumn("aliases", F.array().cast("array<string>"))
    each = p.select(F.concat(F.lit("x"), F.substring("p_name", 2, 1), F.expr("substring(p_name, 4)")).alias("mention"), "p_partkey").groupBy("mention").agg(F.min("p_partkey").alias("mention_id"))
    found = resolve.fuzzy_candidates(each, resolve.alias_index(owners), shared(spark))
    return each.join(found, "mention_id").select("mention", "entity_id", "score")


@query
def topic_word_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind and noun of parts as topics; words are all starts of nouns and kinds."""
    p = table(spark, sf_dir, "part").select(F.lower("p_type").alias("kind"), F.element_at(F.split("p_name", " "), -1).alias("noun")).distinct()
    words = p.select(F.explode(F.array(F.substring("noun", 1, 3), F.substring("noun", 1, 4), F.col("noun"), F.col("kind"), F.concat_ws("_", "kind", "noun"))).alias("word")).distinct()
    return resolve.topic_matches(words, p.select(F.concat_ws("_", "kind", "noun").alias("topic")))


# ------------------------------------------------------------------ grounding


@query
def span_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against its own opening with other quotes and spaces, and against an item of
    ids 0 to 39; `span_ground_items` takes all items."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = d.select("doc_id", F.lit(0).alias("kind"), F.concat(F.lit("  "), F.replace(F.substring("text", 1, 40), F.lit(" "), F.lit(" \n")), F.when(F.col("doc_id") % 4 == 0, "zz").otherwise("")).alias("span"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span"))
    item = d.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(b, "item_id").select("doc_id", F.lit(1).alias("kind"), "span")
    return ground.ground_spans(own.unionByName(item), d).select("doc_id", "kind", "grounded")


@query
def span_ground_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against an item, dealt over all items by their rank."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("span"))
    ids = b.where("item_id is not null").select("item_id").distinct()
    most = max(ids.count(), 1)
    ranked = ids.select("item_id", (F.row_number().over(Window.orderBy("item_id")) - 1).cast("long").alias("place"))
    dealt = d.select("doc_id", F.pmod("doc_id", F.lit(most)).alias("place")).join(ranked.join(b, "item_id"), "place")
    return ground.ground_spans(dealt.select("doc_id", "item_id", "span"), d).select("doc_id", "item_id", "grounded")


@query
def numbers_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each document."""
    n = table(spark, sf_dir, "documents").select("doc_id", F.sort_array(number_set(F.col("text"))).alias("n"))
    return n.select("doc_id", F.size("n").cast("long").alias("n_numbers"), F.array_join("n", " ").alias("numbers"))


@query
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each later turn is a claim that cites the turn before it, each fifth one nothing."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    cites = F.when(F.col("n") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.col("n") - 1))
    return ground.claim_problems(c.select(F.col("n").alias("claim_id"), "text", cites.alias("cited")), c.select("n", F.col("text").alias("body")))


@query
def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening words of items found in documents."""
    b = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("surface"), "item_id")
    b = b.groupBy("surface").agg(F.min("item_id").alias("entity_id"))
    return ground.lexicon_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), b)


@query
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events' props, each seventh one cut short; k must be below 90."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("props"))
    return ground.validated(e, "props", "k int", ("range", F.col("parsed.k") < 90)).select("event_id", F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), F.col("parsed.k")).alias("k"))


# ------------------------------------------------------------------ similarity


def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, embedding, label, event_type: vectors with the time and kind of the event of that id."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "ts", "event_type")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label").join(e, "id")


@query
def windowed_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors within 48 hours."""
    v = vectors_of(spark, sf_dir)
    return cluster.window_neighbours(v, v, digits=6)


@query
def windowed_knn_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As windowed_knn, with cells of about 64 vectors, of which only those that can matter are multiplied."""
    v = vectors_of(spark, sf_dir)
    return cluster.pruned_neighbours(v, v, shared(spark), digits=6, block=64)[0]


@query
def cluster_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters are label pairs, entities labels modulo 3; low bands so that all decisions occur."""
    v = vectors_of(spark, sf_dir)
    near = cluster.window_neighbours(v, v, digits=6)
    clusters, entities = v.select("id", (F.col("label") % 5).alias("cluster")), v.select("id", (F.col("label") % 3).alias("entity"))
    found = cluster.candidate_clusters(near, clusters, entities, clusters.join(entities, "id").select("cluster", "entity").distinct())
    return found.where("rank <= 3").select("id", "cluster", "sim", F.col("overlap").cast("long").alias("overlap"), "rank", "decision")


@query
def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors placed in time order; labels are entities; bands so low that a fifth of these vectors
    joins the head of another."""
    v = vectors_of(spark, sf_dir).select("id", "ts", "embedding", F.array("label").alias("entities"))
    return cluster.leader_clusters(v, shared(spark), low=0.2, high=0.3)


@query
def leader_cluster_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As leader_cluster, in rounds of joins, with a verdict on each vector and each of its nearest earlier
    ones, where that leads a cluster: the pair's sum says whether they are the same, a digit how sure that is."""
    v = vectors_of(spark, sf_dir).select("id", "ts", "embedding", F.array("label").alias("entities"))
    near = rows.kept(cluster.window_neighbours(v, v, earlier=True).where("sim >= 0.2").select("id", "neighbour", "sim"), shared(spark), "neighbours")
    told = near.select("id", F.col("neighbour").alias("cluster"), ((F.col("id") + F.col("neighbour")) % 2 == 0).alias("same"), ((F.col("id") * 7 + F.col("neighbour")) % 10 / 10).alias("confidence"))
    return cluster.placed_in_rounds(v, near, shared(spark), low=0.2, high=0.3, verdicts=told).select("id", "head", "decision", F.col("review").cast("int").alias("review"))


@query
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label, one row per element."""
    c = cluster.centroids(table(spark, sf_dir, "embeddings"), "label", digits=6)
    return c.select("label", F.posexplode("centroid").alias("at", "x"))


@query
def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: labels as heads, with shared entities label % 3 and any similarity of 0 or more."""
    v = vectors_of(spark, sf_dir)
    heads = v.groupBy(F.col("label").alias("head")).agg(F.max("ts").alias("ts"), F.min(F.when(F.col("label") % 2 == 0, "statement").otherwise("other")).alias("event_type")).join(cluster.centroids(v.withColumnRenamed("label", "head"), "head"), "head")
    return cluster.related_heads(heads, v.select(F.col("label").alias("head"), (F.col("label") % 3).alias("entity")), least=0.0).withColumn("sim", F.round("sim", 6))


@query
def head_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as heads of their lines; status is the type, return flag topic and place."""
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_orderkey").alias("head"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("ts"), F.col("l_linestatus").alias("event_type"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("jurisdiction"), F.array("l_returnflag").alias("topics"), F.concat(F.lit("T"), (1 + F.col("l_linenumber") % 4).cast("string")).alias("tier"), (1 - F.col("l_discount")).alias("confidence"))
    return cluster.head_scalars(m).select("head", F.array_join("topics", ",").alias("topics"), "event_time", "tier", F.round("confidence", 8).alias("confidence"), "event_type", "jurisdiction")


@query
def span_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship modes of an order's lines as spans, sources first."""
    li = table(spark, sf_dir, "lineitem").withColumn("span", F.concat_ws("-", "l_returnflag", "l_linestatus"))
    s = li.select(F.col("l_orderkey").alias("head"), F.concat(F.lit("T"), (1 + F.col("l_linenumber") % 4).cast("string")).alias("tier"), F.col("l_linenumber").alias("id"), "span")
    e = li.select(F.col("l_orderkey").alias("head"), F.col("l_linenumber").alias("id"), F.col("l_partkey").alias("entity"), F.lit("r").alias("role"), F.lit("").alias("topic"), F.concat(F.lit("p"), (F.col("l_partkey") % 10).cast("string")).alias("span"))
    return cluster.head_spans(s, e).select("head", F.array_join("spans", ",").alias("spans"))


# ------------------------------------------------------------------ verification


@query
def corroborate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: pages in 50 heads; each third page is a social post."""
    kind = F.when(F.col("page_id") % 3 == 0, "social_post").when(F.col("page_id") % 3 == 1, "news")
    p = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("head"), independence_key(kind, F.col("url")).alias("key"), F.concat(F.lit("T"), (1 + F.col("page_id") % 4).cast("string")).alias("tier"))
    return verify.corroborate(p).select("head", "independent_sources", "score", F.array_join("keys", ",").alias("keys"), "status")


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("asof")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("total"))


@query
def claim_parse_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4-V9: a sentence on each month's change of orders, each fifth one wrong, checked against urgent
    and high priority totals as two sources."""
    m = monthly(spark, sf_dir).where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    ind = m.select(F.lit("CPIAUCSL").alias("series_id"), "asof", F.when(F.col("o_orderpriority") == "1-URGENT", "fred").otherwise("bls").alias("source"), F.col("total").alias("value"))
    prior = ind.where("source = 'fred'").select(F.add_months("asof", 1).alias("asof"), F.col("value").alias("before"))
    both = ind.where("source = 'fred'").join(prior, "asof")
    pct = (F.col("value").cast("double") / F.col("before").cast("double") - 1) * 100
    off = F.when(F.month("asof") % 5 == 0, 1.0).otherwise(0.0)
    verb = F.when(pct < 0, "fell").otherwise("rose")
    said = F.format_string("%.1f", F.abs(pct) + off)
    spans = both.select((F.year("asof") * 100 + F.month("asof")).cast("long").alias("span_id"), F.concat(F.lit("The Core CPI "), verb, F.lit(" by "), said, F.lit("% in "), F.date_format("asof", "MMMM yyyy"), F.lit(", data show")).alias("span"), F.add_months("asof", 2).cast("timestamp").alias("event_time"))
    aliases = spark.createDataFrame([("CPIAUCSL", "CPI"), ("CPIAUCSL", "core cpi"), ("UNRATE", "unemployment"), ("PAYEMS", "payrolls")], "series_id string, alias string")
    return claim.claim_outcomes(claim.parse_claims(spans, aliases), ind).select("span_id", "series_id", "kind", "claimed", "period", "outcome", "disagree")


@query
def stance_asof_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users on topics k % 16; the kind of event is the stance."""
    return verify.stance_flips(stances_of(spark, sf_dir)).select("head", "entity", "topic", "prior_head", "flip")


def stances_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    stance = lookup({"purchase": "strongly_support", "signup": "support", "view": "neutral_unclear", "click": "lean_oppose", "error": "oppose"}, F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("head"), "ts", F.col("user_id").alias("entity"), (k_of() % 16).alias("topic"), F.lit("actor").alias("role"), stance.alias("stance"), (F.col("event_id") % 10 / 10).alias("confidence"), "event_type", "value")


@query
def head_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as heads; lines are sources (key: supplier) and checked claims."""
    li = table(spark, sf_dir, "lineitem").withColumn("tier", F.concat(F.lit("T"), (1 + F.col("l_linenumber") % 4).cast("string")))
    seen = verify.corroborate(li.select(F.col("l_orderkey").alias("head"), F.col("l_suppkey").alias("key"), "tier"))
    outcome = lookup({"R": "mismatch", "A": "match"}, F.col("l_returnflag"), "no_reference")
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("head"), (F.col("o_orderkey") % 100 / 100).alias("base"))
    return verify.head_verdict(heads, seen, li.select(F.col("l_orderkey").alias("head"), outcome.alias("outcome"), "tier")).select("head", "status", F.round("confidence", 6).alias("confidence"))


# ------------------------------------------------------------------ graph and views


@query
def event_race_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with brands as topics; the customer's nation is the state, suppliers' nations those
    of politicians; nations are races."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    brands = li.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy(F.col("l_orderkey").alias("head")).agg(F.collect_set("p_brand").alias("topics"))
    heads = brands.withColumn("confidence", F.col("head") % 10 / 10)
    home = o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("state")), "o_custkey").select(F.col("o_orderkey").alias("head"), "state", F.lit("state").alias("match"))
    away = li.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("state")), "l_suppkey").select(F.col("l_orderkey").alias("head"), "state", F.lit("politician").alias("match")).distinct()
    rating = F.when(F.col("n_nationkey") % 3 == 0, "tossup").when(F.col("n_nationkey") % 3 == 1, "lean_d").otherwise("safe_d")
    salient = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("Brand#"), ((F.col("n_nationkey") + 5 * i) % 25 + 1).cast("string")))
    races = table(spark, sf_dir, "nation").select(F.col("n_name").alias("race_id"), F.col("n_nationkey").alias("state"), rating.alias("rating"), salient.alias("salient"))
    found = graph.race_links(heads, home.unionByName(away), races)
    return found.select("head", "race_id", "match", F.array_join("matched_topics", ",").alias("matched_topics"), F.round("confidence", 6).alias("confidence"))


@query
def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers joined by order lines."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    edges = li.join(o, "l_orderkey").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("l_returnflag").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), (1 - F.col("l_discount")).alias("confidence"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("rationale"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return graph.neighbourhood(edges).withColumn("confidence", F.round("confidence", 6))


@query
def entity_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users; only events of value above 50 have a source."""
    s = stances_of(spark, sf_dir)
    return views.dossier(s, s.select("entity", "head", "ts", "role"), s.where("value > 50").select("head"))


@query
def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users' days as heads, with events of value above 50 as sources."""
    s = stances_of(spark, sf_dir).withColumn("head", F.col("entity") * 100 + F.dayofmonth("ts")).withColumn("id", epoch_us("ts"))
    src = s.where("value > 50").select("head", F.concat(F.lit("T"), (1 + F.col("topic") % 4).cast("string")).alias("tier"), F.col("id"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    told = s.groupBy("head", "entity", "topic", "stance").agg(F.max("confidence").alias("confidence")).withColumn("role", F.col("stance"))
    return views.reactions(told, src).select("head", "entity", "topic", "stance", "tier", "url")


@query
def event_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its lines and suppliers in one row."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    each = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: F.concat(x["l_linenumber"].cast("string"), x["l_returnflag"])), ",").alias("members"),
        F.array_join(F.transform(F.array_sort(F.collect_set("l_suppkey")), lambda x: x.cast("string")), ",").alias("entities"),
    )
    return o.join(each, "o_orderkey").select("o_orderkey", "o_orderstatus", "members", "entities")


@query
def race_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per nation its newest order, the newest with the same status, and how many of its 20
    dearest orders are closed."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey")
    now = rows.first_per_key(o, ["c_nationkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_nationkey", F.col("o_orderstatus").alias("rating"))
    support = rows.first_per_key(o.join(now, "c_nationkey").where("o_orderstatus = rating"), ["c_nationkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("c_nationkey", "rating", F.col("o_orderkey").alias("support"))
    top = o.withColumn("rank", F.row_number().over(views.Window.partitionBy("c_nationkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rank <= 20")
    return support.join(top.groupBy("c_nationkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed")), "c_nationkey")


@query
def reference_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order totals as series by status, priorities as sources."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy(F.col("o_orderstatus").alias("series_id"), F.col("o_orderpriority").alias("source"), F.trunc("o_orderdate", "month").alias("asof")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return views.ticker(m, ("3-MEDIUM", "1-URGENT"))


@query
def retrieve_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads are labels; the question is vector 0 and names label 3."""
    v = vectors_of(spark, sf_dir).withColumnRenamed("label", "head")
    question = v.where("id = 0").select("embedding").first()[0]
    return views.retrieve(v, question, [3], least=0.0)


@query
def number_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a customer's orders numbered over distinct (supplier, flag)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("head"))
    r = table(spark, sf_dir, "lineitem").join(o, "l_orderkey").select("head", F.col("l_linenumber").alias("place"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("url"), F.col("l_returnflag").alias("span"))
    return views.number_records(r).select("head", "n", "url", "span")


@query
def trend_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values in eight bins per user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "value")
    return views.trend_bins(e).select("id", "bin")


# ------------------------------------------------------------------ evaluation


def verdicts_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gold = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    guess = table(spark, sf_dir, "documents").where(F.size(number_set(F.col("text"))) > 0).select("doc_id")
    return gold, guess


@query
def prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: bad documents against those that hold a number."""
    s = graph.micro_scores(*verdicts_of(spark, sf_dir), "doc_id")
    return s.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query
def pass_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: several metrics in long form; `pass_scores` has all of M3."""
    gold, guess = verdicts_of(spark, sf_dir)
    lab = table(spark, sf_dir, "labels").join(guess.withColumn("p", F.lit(1)), "doc_id", "left")
    one = graph.micro_scores(gold, guess, "doc_id")
    acc = graph.ratio(lab, (F.col("quality") == 0) == F.col("p").isNotNull()).select(F.lit("accuracy").alias("metric"), "value")
    return one.select(F.expr("stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)")).unionByName(acc).withColumn("value", F.round("value", 6))


@query
def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the metrics against the same ones over even documents, as a baseline."""
    gold, guess = verdicts_of(spark, sf_dir)
    form = "stack(3, 'precision', precision, 'recall', recall, 'f1', f1) as (metric, value)"
    was = graph.micro_scores(gold.where("doc_id % 2 = 0"), guess.where("doc_id % 2 = 0"), "doc_id").select(F.expr(form))
    out = graph.regressions(graph.micro_scores(gold, guess, "doc_id").select(F.expr(form)), was)
    return out.select("metric", F.round("value", 6).alias("value"), F.round("was", 6).alias("was"), "regressed")


@query
def item_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: flags and numbers of each order's lines other than flag N as labels: gold those shipped before
    March 1999, predicted those of discounts below 0.06."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").withColumn("label", F.concat_ws("-", "l_returnflag", "l_linenumber"))
    side = lambda x: li.where(x).groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_set("label").alias("labels"))
    d = graph.item_diff(side(F.col("l_shipdate") < "1999-03-01"), side(F.col("l_discount") < 0.06))
    return d.select("item", F.array_join("missed", ",").alias("missed"), F.array_join("extra", ",").alias("extra"))


# ------------------------------------------------------------------ streaming


@query
def stream_leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of leader_cluster, in three batches by time, placed among stored clusters."""
    base = shared(spark)
    landing, store, members, state = (ingest.new_folder(base, x) for x in ("landing", "clusters", "members", "state"))
    v = vectors_of(spark, sf_dir).select("id", "ts", F.col("embedding").cast("array<double>").alias("embedding"), F.array(F.col("label").cast("bigint")).alias("entities"))
    a, b = v.agg(F.percentile_approx("ts", F.array(F.lit(0.33), F.lit(0.66))).alias("cut")).first().cut
    for part in (F.col("ts") < a, (F.col("ts") >= a) & (F.col("ts") < b), F.col("ts") >= b):
        v.where(part).write.mode("append").parquet(landing)
        ingest.cluster_as_they_come(spark, landing, ingest.EVENT, store, members, state, base, low=0.2, high=0.3)
    return spark.read.parquet(store).select("id", "head")


@query
def stream_dedup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events file ingested as a stream, twice over; then counts per day and kind."""
    base = shared(spark)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    landing, store, state = (ingest.new_folder(base, x) for x in ("landing", "store", "state"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.write.parquet(landing)
    ingest.ingest_once(spark, landing, schema, ["event_id"], "ts", store, state)
    events.where("event_id % 2 = 0").write.mode("append").parquet(landing)
    ingest.ingest_once(spark, landing, schema, ["event_id"], "ts", store, state)
    out = ingest.daily_counts(ingest.stored(spark, store, schema), "ts", "event_type")
    return out.select("day", "event_type", "n", F.round("total", 2).alias("total"))
