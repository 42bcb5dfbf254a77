"""Verification of heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import lookup, stance_side
from tracewell.operators.rows import first_per_key
from tracewell.params import KNOBS, TIER_WEIGHT


def corroborate(sources: DataFrame) -> DataFrame:
    """sources (head, key, tier) as head, independent_sources, score, keys, status (V2): each
    independent key counts once, with its best tier."""
    best = sources.groupBy("head", "key").agg(F.min("tier").alias("tier"))
    out = best.groupBy("head").agg(F.count(F.lit(1)).alias("independent_sources"), F.round(F.sum(lookup(TIER_WEIGHT, F.col("tier"))), 4).alias("score"), F.sort_array(F.collect_list("key")).alias("keys"))
    return out.withColumn("status", F.when(F.col("independent_sources") >= 2, "corroborated").otherwise("single_source"))


def linked_series(links: DataFrame, entities: DataFrame) -> DataFrame:
    """head, series_id, surfaces: the registered series among the indicators that heads link to (head,
    entity_id), with what names them, name first (V3).  entities: entity_id, canonical_id, entity_type,
    name, aliases."""
    known = entities.where((F.col("entity_type") == "EconomicIndicator") & F.col("canonical_id").startswith("fred:"))
    surfaces = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    known = known.select("entity_id", F.substring_index("canonical_id", ":", -1).alias("series_id"), surfaces.alias("surfaces"))
    return links.select("head", "entity_id").distinct().join(known, "entity_id").select("head", "series_id", "surfaces")


def disagreements(references: DataFrame, slack: float = 1e-9) -> DataFrame:
    """references (head, series_id, kind, period, yoy, source, reference) whose two sources differ by more
    than the tolerance, once for each head, series, period and kind of change: ..., fred, bls (V9)."""
    own = ["head", "series_id", "kind", "period", "yoy"]
    both = references.groupBy(*own).agg(F.max(F.when(F.col("source") == "fred", F.col("reference"))).alias("fred"), F.max(F.when(F.col("source") == "bls", F.col("reference"))).alias("bls"))
    most = F.when(F.col("kind") == "change_thousands", KNOBS.tolerance_thousands).otherwise(KNOBS.tolerance_pct)
    return both.where(F.abs(F.col("fred") - F.col("bls")) > most + slack)


def stance_sources(stances: DataFrame, members: DataFrame, member_stances: DataFrame, sources: DataFrame) -> DataFrame:
    """stances (head, entity, topic, role, span) with url and tier of the source of the member that said
    just that: the best tier, then the least source (V14).  members: head, id; member_stances: id, entity,
    topic, role, span; sources: id, source_id, tier, url.  Null where no member did."""
    key = ["entity", "topic", "role", "span"]
    said = members.join(member_stances.select("id", *key), "id").join(sources, "id")
    best = first_per_key(said.select("head", *key, "tier", "source_id", "url"), ["head", *key], F.col("tier"), F.col("source_id"))
    return stances.join(best.drop("source_id"), ["head", *key], "left")


def flip_details(flips: DataFrame, sourced: DataFrame) -> DataFrame:
    """flips of stance_flips with flip_of, null without a flip: the prior head, its time, stance, span and the
    url of its source (V13).  sourced: head, entity, topic, role, ts, stance, span, url; of several roles on
    the prior head, the first."""
    prior = first_per_key(sourced, ["head", "entity", "topic"], F.col("role")).select(F.col("head").alias("prior_head"), "entity", "topic", F.struct(F.col("ts").alias("time"), "stance", "span", "url").alias("_prior"))
    both = flips.join(prior, ["prior_head", "entity", "topic"], "left")
    told = F.struct(F.col("prior_head").alias("head"), F.col("_prior.time").alias("time"), F.col("_prior.stance").alias("stance"), F.col("_prior.span").alias("span"), F.col("_prior.url").alias("url"))
    return both.withColumn("flip_of", F.when(F.col("flip"), told)).drop("_prior")


def stance_flips(stances: DataFrame, least: float = KNOBS.stance_confidence) -> DataFrame:
    """stances (head, ts, entity, topic, role, stance, confidence) with prior_head and flip.

    The prior is the latest stance of the entity on the topic on a head strictly earlier by (ts, head),
    whatever its side or confidence; of several roles there, the first.  Distinct heads are scanned in
    segments, the days of an entity and topic: within one by lag, and its first head looks at the last of the
    day before that has any; so an entity and topic of a third of all rows is many tasks."""
    first = F.min_by(F.struct("stance", "confidence"), "role")
    heads = stances.groupBy("entity", "topic", "ts", "head").agg(first.alias("said")).withColumn("day", F.to_date("ts"))
    key = ["entity", "topic"]
    order = Window.partitionBy(*key, "day").orderBy("ts", "head")
    last = heads.groupBy(*key, "day").agg(F.max_by(F.struct("head", "said"), F.struct("ts", "head")).alias("last"))
    carried = last.select(*key, "day", F.lag("last").over(Window.partitionBy(*key).orderBy("day")).alias("carried"))
    prior = heads.withColumn("prior", F.lag(F.struct("head", "said")).over(order)).join(carried, [*key, "day"])
    prior = prior.select(*key, "ts", "head", F.coalesce("prior", "carried").alias("prior"))
    both = stances.join(prior, ["entity", "topic", "ts", "head"])
    side, before = stance_side(F.col("stance")), stance_side(F.col("prior.said.stance"))
    flip = F.coalesce((F.col("confidence") >= least) & (F.col("prior.said.confidence") >= least) & (side * before == -1), F.lit(False))
    return both.select("head", "ts", "entity", "topic", "role", "stance", "confidence", F.col("prior.head").alias("prior_head"), flip.alias("flip"))


def head_verdict(heads: DataFrame, corroboration: DataFrame, numeric: DataFrame, penalty: float = KNOBS.numeric_penalty) -> DataFrame:
    """heads (head, base) with status and confidence (V10, V15).  numeric: head, outcome, tier of each
    checked claim."""
    bad, good = F.col("outcome") == "mismatch", F.col("outcome") == "match"
    checks = numeric.groupBy("head").agg(F.bool_or(bad).alias("mismatched"), F.bool_or(good).alias("matched"), F.bool_or(good & F.col("tier").isin("T1", "T2")).alias("trusted"))
    out = heads.join(corroboration.select("head", F.col("status").alias("seen")), "head", "left").join(checks, "head", "left").na.fill(False, ["mismatched", "matched", "trusted"])
    checked = ~F.col("mismatched") & F.col("trusted")
    status = F.when(checked, "fact_checked").otherwise(F.coalesce("seen", F.lit("unverified")))
    confidence = F.when(F.col("mismatched") & ~F.col("matched"), F.col("base") * penalty).otherwise(F.col("base"))
    return out.select("head", status.alias("status"), confidence.alias("confidence"), "mismatched", "matched")


def review_rows(verdicts: DataFrame, flips: DataFrame, disagreeing: DataFrame | None = None, least: float = KNOBS.review_confidence) -> DataFrame:
    """(head, kind, field) of what needs a look (V16): flips; mismatched claims or sources that disagree (head),
    one row for both; low confidence."""
    odd = verdicts.where("mismatched").select("head")
    if disagreeing is not None:
        odd = odd.unionByName(disagreeing.select("head"))
    told = lambda rows, kind, field: rows.select("head").distinct().select("head", F.lit(kind).alias("kind"), F.lit(field).alias("field"))
    out = told(flips.where("flip"), "verification", "verify:stance_flip").unionByName(told(odd, "verification", "verify:numeric"))
    return out.unionByName(told(verdicts.where(F.col("confidence") < least), "low_confidence", "verify:confidence"))
