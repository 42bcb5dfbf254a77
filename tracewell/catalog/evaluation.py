"""Evaluation and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.catalog import query, table
from tracewell.catalog.extraction import pick
from tracewell.catalog.sources import shared
from tracewell.operators import graph
from tracewell.oracles import STANCES
from tracewell.streaming import flips, ingest

G = "(SELECT event_id AS i, user_id, event_id % 5 > 0 AS g, event_id % 7 > 0 AS p, event_id % 11 = 0 AS failed, CASE WHEN event_id % 3 > 0 THEN event_type END AS gt, CASE WHEN user_id % 4 = 0 THEN 'view' ELSE event_type END AS pt, 'e' || user_id % 9 AS ge, 'e' || CASE WHEN event_id % 4 = 0 THEN 99 ELSE user_id % 9 END AS pe, 't' || event_id % 6 AS tg, 't' || event_id % 3 AS tp, ['support', 'oppose', 'strongly_support', 'neutral_unclear'][event_id % 4 + 1] AS sg, ['support', 'support', 'support', 'oppose'][event_id % 4 + 1] AS sp FROM events)"


def rates(name: str, gold: str, guess: str, on: str = "g") -> str:
    """SQL of precision, recall and f1 of one guess per item (p: there is one) against one gold label."""
    return f"(SELECT '{name}' AS m, sum(h) / sum(CASE WHEN pp THEN 1 ELSE 0 END) AS p, sum(h) / sum(CASE WHEN gg THEN 1 ELSE 0 END) AS r FROM (SELECT {gold} IS NOT NULL AS gg, {guess} IS NOT NULL AS pp, CASE WHEN {gold} = {guess} THEN 1 ELSE 0 END AS h FROM {G} WHERE {on}))"


@query(f"""
WITH r AS (SELECT * FROM {rates('gate.drop', 'CASE WHEN NOT g THEN 1 END', 'CASE WHEN NOT p THEN 1 END', 'true')} UNION ALL SELECT * FROM {rates('entities', 'ge', 'CASE WHEN p THEN pe END')} UNION ALL SELECT * FROM {rates('topics', 'tg', 'CASE WHEN p THEN tp END')} UNION ALL SELECT * FROM {rates('stance', 'ge || tg', 'CASE WHEN p THEN pe || tp END')}),
b AS (SELECT avg(CASE WHEN sg = sp THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN (sg LIKE '%support') = (sp LIKE '%support') AND (sg LIKE '%oppose') = (sp LIKE '%oppose') THEN 1.0 ELSE 0.0 END) AS d FROM {G} WHERE g AND p AND ge = pe AND tg = tp),
m AS (SELECT 'items' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {G} UNION ALL SELECT 'failed', CAST(count(*) FILTER (failed) AS DOUBLE) FROM {G} UNION ALL SELECT 'gate.accuracy', avg(CASE WHEN g = p THEN 1.0 ELSE 0.0 END) FROM {G}
 UNION ALL SELECT 'event_type.accuracy', avg(CASE WHEN gt = pt THEN 1.0 ELSE 0.0 END) FROM {G} WHERE g AND p AND gt IS NOT NULL
 UNION ALL SELECT CASE m WHEN 'gate.drop' THEN 'gate.drop_precision' ELSE m || '.precision' END, p FROM r UNION ALL SELECT CASE m WHEN 'gate.drop' THEN 'gate.drop_recall' ELSE m || '.recall' END, r FROM r UNION ALL SELECT m || '.f1', 2 * p * r / (p + r) FROM r WHERE m <> 'gate.drop'
 UNION ALL SELECT 'stance.position_accuracy', a FROM b UNION ALL SELECT 'stance.direction_accuracy', d FROM b)
SELECT metric, round(value, 6) AS value FROM m""")
def pass_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: all 17 metrics of events as items, with one gold and one predicted entity, topic and stance."""
    k, u = F.col("event_id"), F.col("user_id")
    e = table(spark, sf_dir, "events")
    text = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    base = e.select(
        k.alias("item"), (k % 5 > 0).alias("g"), (k % 7 > 0).alias("p"), (k % 11 == 0).alias("failed"), F.when(k % 3 > 0, F.col("event_type")).alias("gt"), F.when(u % 4 == 0, "view").otherwise(F.col("event_type")).alias("pt"),
        text("e", u % 9).alias("ge"), text("e", F.when(k % 4 == 0, 99).otherwise(u % 9)).alias("pe"), text("t", k % 6).alias("tg"), text("t", k % 3).alias("tp"), pick(k, "support", "oppose", "strongly_support", "neutral_unclear").alias("sg"), pick(k, "support", "support", "support", "oppose").alias("sp"),
    )
    gold = base.select("item", F.col("g").alias("relevant"), F.col("gt").alias("event_type"))
    guess = base.select("item", F.col("p").alias("relevant"), "failed", F.col("pt").alias("event_type"))
    kept = base.where("p")
    sets = lambda x, a, b, c: {"entities": x.select("item", F.col(a).alias("entity")), "topics": x.select("item", F.col(b).alias("topic")), "stances": x.select("item", F.col(a).alias("entity"), F.col(b).alias("topic"), F.col(c).alias("position"))}
    return graph.pass_scores(gold, guess, sets(base, "ge", "tg", "sg"), sets(kept, "pe", "tp", "sp")).withColumn("value", F.round("value", 6))


@query("""
SELECT l_orderkey AS item, 'k' || l_suppkey % 4 AS canonical_id, NOT bool_or(l_returnflag = 'R') AS scored FROM lineitem WHERE l_suppkey % 5 > 0 GROUP BY ALL HAVING bool_or(l_returnflag <> 'R')""")
def structural_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: lines as links of their order; returned ones have the role of sponsor."""
    s = F.col("l_suppkey")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.when(s % 5 > 0, F.concat(F.lit("k"), (s % 4).cast("string"))).alias("canonical_id"), F.when(F.col("l_returnflag") == "R", "sponsor").otherwise("actor").alias("role"))
    return graph.scored_entities(links)


@query("""
SELECT o_orderkey AS item, 'duplicate id' AS problem FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0) GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT DISTINCT l_orderkey, 'stance of ' || l_suppkey FROM lineitem l WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_suppkey = l.l_suppkey AND m.l_returnflag <> 'A')""")
def golden_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: orders as items, each ninth twice; accepted lines as stances, others as what the item names."""
    o, li = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("entity"), "l_returnflag")
    return graph.golden_problems(o.unionByName(o.where("item % 9 = 0")), li.where("l_returnflag = 'A'"), li.where("l_returnflag <> 'A'").select("item", "entity"))


@query("""
SELECT metric, round(value, 6) AS value, CASE WHEN same THEN was - value > 0.02 + 1e-12 END AS regressed FROM (SELECT unnest(['a', 'b']) AS metric, unnest([avg(o_orderkey % 10) / 10, avg(o_orderkey % 7) / 7]) AS value, unnest([avg(o_orderkey % 10) / 10 + 0.05, avg(o_orderkey % 7) / 7]) AS was, true AS same FROM orders)
UNION ALL SELECT 'c', round(avg(o_orderkey % 10) / 10, 6), NULL FROM orders""")
def regression_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: two metrics against a baseline of the same items, one against a baseline of others."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    m = o.agg((F.avg(k % 10) / 10).alias("a"), (F.avg(k % 7) / 7).alias("b"))
    form = lambda x, y: m.select(F.expr(f"stack(2, 'a', {x}, 'b', {y}) as (metric, value)"))
    same = graph.same_rows(o.select("o_orderkey"), o.select("o_orderkey"))
    other = graph.same_rows(o.select("o_orderkey"), o.where("o_orderkey % 2 = 0").select("o_orderkey"))
    one = m.select(F.expr("stack(1, 'c', a) as (metric, value)"))
    out = graph.regressions(form("a", "b"), form("a + 0.05", "b"), same_items=same).unionByName(graph.regressions(one, one, same_items=other))
    return out.select("metric", F.round("value", 6).alias("value"), "regressed")


@query("""
SELECT CAST(0 AS INT) AS batch, event_type, count(*) AS fetched, count(*) AS inserted, CAST(0 AS BIGINT) AS skipped FROM events GROUP BY event_type
UNION ALL SELECT 1, event_type, count(*), CAST(0 AS BIGINT), count(*) FROM events WHERE event_id % 2 = 0 GROUP BY event_type""")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events ingested as a stream, then even ones once more: what each batch did."""
    base = shared(spark)
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    landing, store, state, counters = (ingest.new_folder(base, x) for x in ("landing", "store", "state", "counters"))
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    for part in (events, events.where("event_id % 2 = 0")):
        part.write.mode("append").parquet(landing)
        ingest.ingest_once(spark, landing, schema, ["event_id"], "ts", store, state, counters, "event_type")
    return spark.read.schema("event_type string, fetched bigint, inserted bigint, skipped bigint, batch int").parquet(counters).select("batch", "event_type", "fetched", "inserted", "skipped")


@query(f"""
SELECT head, entity, topic, p AS prior_head, coalesce(c >= 0.6 AND pc >= 0.6 AND side * ps = -1, false) AS flip FROM
(SELECT *, lag(head) OVER w AS p, lag(c) OVER w AS pc, lag(side) OVER w AS ps FROM {STANCES} WINDOW w AS (PARTITION BY entity, topic ORDER BY ts, head))""")
def stream_flip_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As stream_late_flips, by state per entity and topic; a batch writes only rows that came or changed."""
    from tracewell.queries import stances_of

    base = shared(spark)
    landing, out, state = (ingest.new_folder(base, x) for x in ("landing", "flips", "state"))
    s = stances_of(spark, sf_dir).select("head", "ts", "entity", "topic", "role", "stance", "confidence")
    for part in (s.where("head % 3 > 0"), s.where("head % 3 = 0")):
        part.write.mode("append").parquet(landing)
        flips.flip_changes(spark, landing, out, state)
    return flips.latest_flips(spark, out).select("head", "entity", "topic", "prior_head", "flip")


@query(f"""
SELECT head, entity, topic, p AS prior_head, coalesce(c >= 0.6 AND pc >= 0.6 AND side * ps = -1, false) AS flip FROM
(SELECT *, lag(head) OVER w AS p, lag(c) OVER w AS pc, lag(side) OVER w AS ps FROM {STANCES} WINDOW w AS (PARTITION BY entity, topic ORDER BY ts, head))""")
def stream_late_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stances of events in two files, the second with what is late; the flips are those of all in the
    order of time."""
    from tracewell.queries import stances_of

    base = shared(spark)
    landing, store, out, state = (ingest.new_folder(base, x) for x in ("landing", "store", "flips", "state"))
    s = stances_of(spark, sf_dir).select("head", "ts", "entity", "topic", "role", "stance", "confidence")
    for part in (s.where("head % 3 > 0"), s.where("head % 3 = 0")):
        part.write.mode("append").parquet(landing)
        ingest.flips_as_they_come(spark, landing, store, out, state)
    return spark.read.schema(ingest.FLIP + ", bucket int").parquet(out).select("head", "entity", "topic", "prior_head", "flip")
