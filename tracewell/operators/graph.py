"""Edges, neighbourhoods, race links and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import lookup, stance_side
from tracewell.operators.rows import dealt, first_per_key
from tracewell.params import KNOBS, STRUCTURAL_ROLES


def head_edges(edges: DataFrame) -> DataFrame:
    """edges (head, id, src, relation, dst, confidence): per head one of each kind, the surest (G1)."""
    return first_per_key(edges, ["head", "src", "relation", "dst"], F.desc("confidence"), F.col("id"))


def neighbourhood(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """edges (src, relation, dst, confidence, rationale, ts, id) seen from either end (G2): entity,
    direction, relation, neighbour, edge_count, confidence, rationale, latest.  With edges that also have
    their head and sources (head, id, tier, url) there are tier and url of the best source of the latest
    edge's head, and groups whose latest head has none go."""
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "id", "rationale"))
    last = [F.max(F.struct("ts", "id", "head"))["head"].alias("head")] if sources is not None else []
    found = edges.groupBy("src", "relation", "dst").agg(F.count(F.lit(1)).alias("edge_count"), F.max("confidence").alias("confidence"), best["rationale"].alias("rationale"), F.max("ts").alias("latest"), *last)
    shown = ["edge_count", "confidence", "rationale", "latest"]
    if sources is not None:
        top = first_per_key(sources, ["head"], F.col("tier"), F.col("id")).select("head", "tier", "url")
        found, shown = found.join(top, "head"), [*shown, "tier", "url"]
    # Either end has the same edges, so they are grouped once and told twice.
    way = lambda entity, name, neighbour: F.struct(F.col(entity).alias("entity"), F.lit(name).alias("direction"), F.col(neighbour).alias("neighbour"))
    both = found.withColumn("way", F.explode(F.array(way("src", "out", "dst"), way("dst", "in", "src"))))
    return both.select("way.entity", "way.direction", "relation", "way.neighbour", *shown)


def event_states(heads: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """States that heads (head, jurisdiction) bear on (G3): head, state, match, why.  Their jurisdiction and
    the races that they name are 'state', the home states of politicians 'politician', federal heads have
    one row without a state.  links: head, entity_id; entities: entity_id, canonical_id, entity_type, fips;
    of several the first by canonical id, jurisdictions before races."""
    own = heads.where(F.col("jurisdiction").startswith("fips:")).select("head", F.substring_index("jurisdiction", ":", -1).alias("state"), F.lit("state").alias("match"), F.concat(F.lit("event jurisdiction "), "jurisdiction").alias("why"), F.lit("").alias("by"))
    named = links.select("head", "entity_id").distinct().join(entities.where("fips is not null"), "entity_id")
    race = named.where("entity_type = 'Race'").select("head", F.col("fips").alias("state"), F.lit("state").alias("match"), F.concat(F.lit("event names "), "canonical_id").alias("why"), F.col("canonical_id").alias("by"))
    home = named.where("entity_type = 'Politician'").select("head", F.col("fips").alias("state"), F.lit("politician").alias("match"), F.concat(F.lit("involves "), "canonical_id").alias("why"), F.col("canonical_id").alias("by"))
    placed = first_per_key(own.unionByName(race).unionByName(home), ["head", "state", "match"], F.col("by")).drop("by")
    federal = heads.where("jurisdiction = 'federal'").select("head", F.lit(None).cast("string").alias("state"), F.lit("federal").alias("match"), F.lit("federal event").alias("why"))
    return placed.unionByName(federal)


def supporting_ratings(races: DataFrame, history: DataFrame) -> DataFrame:
    """The newest row of history (race_id, id, rater, rating, asof) that equals each race's rating (race_id,
    rating) (G5)."""
    same = history.join(races.select("race_id", "rating"), ["race_id", "rating"])
    return first_per_key(same, ["race_id"], F.desc("asof"), F.desc("id"))


def race_links(heads: DataFrame, states: DataFrame, races: DataFrame) -> DataFrame:
    """heads (head, confidence, topics) in states (head, state, match: state, politician or federal) with
    races (race_id, state, rating, salient) that they may bear on (G4): head, race_id, match,
    matched_topics, confidence.  A federal head, whatever its state, bears on all states without a nearer
    match."""
    rank = lookup({"state": 0, "politician": 1}, F.col("match"))
    way = first_per_key(states.where("match <> 'federal'"), ["head", "state"], rank).select("head", "state", F.col("match").alias("near"))
    federal = states.where("match = 'federal'").select("head").distinct().withColumn("far", F.lit("federal"))
    weights = {r: KNOBS.rating_weight["tossup" if r.startswith("tossup") else "lean"] for r in ("tossup", "tossup_d", "tossup_r", "lean_d", "lean_r")}
    open_races = races.withColumn("weight", lookup(weights, F.col("rating"))).where("weight is not null")
    topic = heads.select("head", F.col("confidence").alias("head_confidence"), F.explode("topics").alias("topic"))
    shared = topic.join(open_races.select("race_id", "state", "weight", F.explode("salient").alias("topic")), "topic")
    placed = shared.join(way, ["head", "state"], "left").join(federal, "head", "left").withColumn("match", F.coalesce("near", "far")).where("match is not null")
    met = placed.groupBy("head", "race_id", "match", "weight", "head_confidence").agg(F.sort_array(F.collect_set("topic")).alias("matched_topics"))
    value = F.col("weight") * lookup(KNOBS.match_weight, F.col("match")) * F.col("head_confidence")
    return met.select("head", "race_id", "match", "matched_topics", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("confidence"))


def micro_scores(gold: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over two sets of rows (M1).  Empty denominators give 1, and f1
    is 0 where both others are."""
    both = gold.select(*keys).distinct().withColumn("g", F.lit(1)).join(predicted.select(*keys).distinct().withColumn("p", F.lit(1)), list(keys), "full")
    hit = F.col("g").isNotNull() & F.col("p").isNotNull()
    n = both.agg(F.count_if(hit).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(1.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(1.0))
    return n.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def ratio(rows: DataFrame, ok) -> DataFrame:
    """value: the share of rows for which ok holds, 1 without rows (M2)."""
    return rows.agg(F.coalesce(F.avg(ok.cast("double")), F.lit(1.0)).alias("value"))


def regressions(metrics: DataFrame, baseline: DataFrame, most: float = KNOBS.regression, same_items: bool = True) -> DataFrame:
    """metrics (metric, value) with was and regressed, whether they fell by more than `most` below the
    baseline (M6); null where the items differ, since rates of other items cannot be compared."""
    both = metrics.join(baseline.withColumnRenamed("value", "was"), "metric")
    fell = F.col("was") - F.col("value") > most + 1e-12
    return both.select("metric", "value", "was", F.when(F.lit(same_items), fell).alias("regressed"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two lists of items hold the same ones (M6)."""
    apart = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns, "full").where("_a is null or _b is null")
    return apart.limit(1).count() == 0


def scored_entities(links: DataFrame) -> DataFrame:
    """links (item, canonical_id, role) as item, canonical_id, scored: entities with a structural role
    anywhere in the item are excluded, even where they have another role too (M4).  Entities with
    structural roles alone are left out."""
    roles = links.where("canonical_id is not null").groupBy("item", "canonical_id").agg(F.bool_or(F.col("role").isin(*STRUCTURAL_ROLES)).alias("structural"), F.bool_or(~F.col("role").isin(*STRUCTURAL_ROLES)).alias("other"))
    return roles.where("other").select("item", "canonical_id", (~F.col("structural")).alias("scored"))


def pass_scores(gold: DataFrame, predicted: DataFrame, gold_sets: dict[str, DataFrame], predicted_sets: dict[str, DataFrame]) -> DataFrame:
    """metric, value of all passes (M3).  gold: item, relevant, event_type; predicted: item, relevant,
    failed, event_type; sets: 'entities' (item, entity), 'topics' (item, topic), 'stances' (item, entity,
    topic, position).  Items that gold holds irrelevant count for the gate alone; event types only where
    they are predicted relevant; positions and directions on pairs that both have."""
    both = gold.select("item", F.col("relevant").alias("g"), F.col("event_type").alias("gt")).join(predicted.select("item", F.col("relevant").alias("p"), "failed", F.col("event_type").alias("pt")), "item")
    typed = F.col("g") & F.col("p") & F.col("gt").isNotNull()
    rate = lambda ok, on: F.coalesce(F.avg(F.when(on, ok.cast("double"))), F.lit(1.0))
    base = both.agg(F.count(F.lit(1)).cast("double").alias("items"), F.coalesce(F.sum(F.col("failed").cast("double")), F.lit(0.0)).alias("failed"), rate(F.col("g") == F.col("p"), F.lit(True)).alias("gate"), rate(F.col("gt").eqNullSafe(F.col("pt")), typed).alias("type"))
    out = base.select(F.expr("stack(4, 'items', items, 'failed', failed, 'gate.accuracy', gate, 'event_type.accuracy', type) as (metric, value)"))
    drops = micro_scores(both.where("not g"), both.where("not p"), "item")
    out = out.unionByName(drops.select(F.expr("stack(2, 'gate.drop_precision', precision, 'gate.drop_recall', recall) as (metric, value)")))
    relevant = both.where("g").select("item")
    keys = {"entities": ["item", "entity"], "topics": ["item", "topic"], "stances": ["item", "entity", "topic"]}
    for name, key in keys.items():
        own, guess = (sets[name].join(relevant, "item", "left_semi") for sets in (gold_sets, predicted_sets))
        label = "stance" if name == "stances" else name
        out = out.unionByName(micro_scores(own, guess, *key).select(F.expr(f"stack(3, '{label}.precision', precision, '{label}.recall', recall, '{label}.f1', f1) as (metric, value)")))
    pairs = gold_sets["stances"].join(relevant, "item", "left_semi").join(predicted_sets["stances"].withColumnRenamed("position", "said"), keys["stances"])
    exact = pairs.agg(F.coalesce(F.avg((F.col("position") == F.col("said")).cast("double")), F.lit(1.0)).alias("a"), F.coalesce(F.avg((stance_side(F.col("position")) == stance_side(F.col("said"))).cast("double")), F.lit(1.0)).alias("b"))
    return out.unionByName(exact.select(F.expr("stack(2, 'stance.position_accuracy', a, 'stance.direction_accuracy', b) as (metric, value)")))


def item_diff(gold: DataFrame, predicted: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Per item the labels missed, extra and, with excluded, those that are not scored (M5).  All: item,
    labels."""
    both = gold.select("item", F.col("labels").alias("g")).join(predicted.select("item", F.col("labels").alias("p")), "item", "full")
    if excluded is not None:
        both = both.join(excluded.select("item", F.col("labels").alias("x")), "item", "full")
    none = F.array().cast("array<string>")
    g, p = F.coalesce("g", none), F.coalesce("p", none)
    more = [F.sort_array(F.coalesce("x", none)).alias("excluded")] if excluded is not None else []
    return both.select("item", F.sort_array(F.array_except(g, p)).alias("missed"), F.sort_array(F.array_except(p, g)).alias("extra"), *more)


def golden_problems(items: DataFrame, stances: DataFrame, named: DataFrame) -> DataFrame:
    """item, problem of a golden set (M7): ids that occur twice (items: item), and stances (item, entity) of
    entities that the item neither lists nor resolves (named: item, entity)."""
    twice = dealt(items.select("item"), ["item"]).groupBy("item").count().where("count > 1").select("item", F.lit("duplicate id").alias("problem"))
    # Nothing equals a null, so names with one are no names.
    known = named.where("item is not null and entity is not null").select("item", "entity", F.lit(True).alias("known"))
    both = dealt(stances.select("item", "entity", F.lit(False).alias("known")).unionByName(known), ["item", "entity"])
    strange = both.groupBy("item", "entity").agg(F.bool_or(~F.col("known")).alias("said"), F.bool_or("known").alias("known")).where("said and not known")
    return twice.unionByName(strange.select("item", F.concat(F.lit("stance of "), F.col("entity").cast("string")).alias("problem")))
