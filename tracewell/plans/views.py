"""Rolled-up views."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import cosine, election_proximity, epoch_us, recency, salience
from tracewell.operators.rows import first_per_key
from tracewell.operators.verify import stance_sources
from tracewell.params import KNOBS, SOURCE_PREFERENCE


def top_source(sources: DataFrame) -> DataFrame:
    """The best source of each head, by tier and id."""
    return first_per_key(sources, ["head"], F.col("tier"), F.col("id"))


def feed(heads: DataFrame, now: str, days: int = KNOBS.feed_days, limit: int = 50, provenance: DataFrame | None = None) -> DataFrame:
    """heads (head, kind, ts, sources, importance, bonus, link_confidence, cycle) in the window up to
    now, ranked (W2, G7-G10).  Components have 4 places and the total 6, before ranking.  With provenance
    (head, id, tier, url, span) heads without a source go before the limit, the others have that of their
    best one, and source_count, the number of all."""
    at = F.lit(now).cast("timestamp_ntz")
    recent = heads.where((F.col("ts") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= at))
    shown = []
    if provenance is not None:
        counts = provenance.groupBy("head").agg(F.count(F.lit(1)).alias("source_count"))
        recent = recent.join(top_source(provenance).select("head", "tier", "url", "span").join(counts, "head"), "head")
        shown = ["source_count", "tier", "url", "span"]
    r, e = recency(F.col("ts"), at), election_proximity(F.col("link_confidence"), F.col("cycle"), at)
    total = salience(r, F.col("sources"), F.col("importance"), F.col("bonus"), e)
    parts = {"recency": r, "source_part": F.log(1 + F.col("sources").cast("double")), "importance_part": F.col("importance"), "verification": F.col("bonus"), "election": e}
    out = recent.select("head", "kind", "ts", *shown, *[F.round(v, 4).alias(k) for k, v in parts.items()], F.round(total, 6).alias("salience"))
    return out.orderBy(F.desc("salience"), F.desc("ts"), "head").limit(max(1, min(limit, 200)))


def reactions(stances: DataFrame, sources: DataFrame, flips: DataFrame | None = None) -> DataFrame:
    """The surest reaction per head, entity and topic with a source; those without go (W4).  With flips (head,
    entity, topic, flip_of) there is flip_of, null without one."""
    known = stances.join(top_source(sources).select("head", "tier", "url"), "head")
    best = first_per_key(known, ["head", "entity", "topic"], F.col("tier"), F.desc("confidence"), F.col("role"))
    if flips is None:
        return best
    marked = flips.where("flip_of is not null").select("head", "entity", "topic", "flip_of").dropDuplicates(["head", "entity", "topic"])
    return best.join(marked, ["head", "entity", "topic"], "left")


def affected_races(links: DataFrame, races: DataFrame) -> DataFrame:
    """links (head, race_id, confidence, matched_topics) of each head with the race's rating and place, by
    confidence, then race (W6).  races: race_id, rating."""
    place = F.row_number().over(Window.partitionBy("head").orderBy(F.desc("confidence"), "race_id"))
    return links.join(races.select("race_id", "rating"), "race_id").withColumn("place", place)


def stance_timeline(stances: DataFrame, members: DataFrame, member_stances: DataFrame, sources: DataFrame, flips: DataFrame) -> DataFrame:
    """Stances of heads (head, ts, entity, topic, role, stance, confidence, span) that a member said with its
    source, one for each (head, topic, role), with flip_of and place, oldest first (W7)."""
    said = stance_sources(stances, members, member_stances, sources).where("url is not null")
    marked = flips.where("flip_of is not null").select("head", "entity", "topic", "role", "flip_of")
    place = F.row_number().over(Window.partitionBy("entity", "topic").orderBy("ts", "head", "role"))
    return said.join(marked, ["head", "entity", "topic", "role"], "left").withColumn("place", place)


def _listed(rows: DataFrame, key: str, name: str, order: list, columns: list[str]) -> DataFrame:
    """key, name: the columns of its rows as an array of structs in order."""
    ranked = rows.select(key, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*columns).alias("row")).alias("ranked"))
    return ranked.groupBy(key).agg(F.sort_array(F.collect_list("ranked"))["row"].alias(name))


def _downwards(value: Column) -> Column:
    """A number by which values go down: NaN first, null last, as in a descending order."""
    x = value.cast("double")
    return F.when(x.isNull(), float("nan")).when(F.isnan(x), float("-inf")).otherwise(-x)


def _apart(x: Column, before: Column, *keys: str) -> Column:
    """Whether an element of a sorted array differs in a key from the one before."""
    return ~reduce(and_, [x[k].eqNullSafe(before[k]) for k in keys])


def _firsts(name: str, *keys: str) -> Column:
    """The first element of each key of the sorted array."""
    return F.filter(name, lambda x, i: (i == 0) | _apart(x, F.get(name, i - 1), *keys))


def event_objects(heads: DataFrame, facts: DataFrame, related: DataFrame) -> DataFrame:
    """One row per head with its parts as arrays, null without any (W3).  heads: head and any columns, its
    verification among them; related: rows of related_both_ways with ts; facts: head and what a row tells of it, in the
    structs member (id), entity (entity, name, role), source (id, tier, url, span), stance (entity, topic, stance,
    confidence, role) and race (race_id, rating, confidence), null where it tells nothing.

    members, and entities by name with their sorted roles, are distinct; sources go by tier and id; reactions are the
    surest stance on each entity and topic with the first source, of heads that have one (W4); races have their
    surest link and go by confidence (W6).  Facts are grouped by head once, for all parts, and what repeats is found by
    looking one element back, so a long list takes no longer for each of its elements."""
    has = lambda part, *columns: F.when(F.col(part).isNotNull(), F.struct(*columns)).alias(part)
    told = facts.select(
        "head",
        F.col("member.id").alias("member"),
        has("entity", "entity.name", "entity.entity", "entity.role"),
        has("source", "source.tier", "source.id", "source.url", "source.span"),
        has("stance", "stance.entity", "stance.topic", _downwards(F.col("stance.confidence")).alias("down"), "stance.role", "stance.stance"),
        has("race", "race.race_id", _downwards(F.col("race.confidence")).alias("down"), "race.rating", "race.confidence"),
    )
    rows = told.groupBy("head").agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in told.columns[1:]])
    names = F.filter(F.sequence(F.lit(0), F.size("entity") - 1), lambda i: (i == 0) | _apart(F.get("entity", i), F.get("entity", i - 1), "name", "entity"))
    rows = rows.withColumns({"names": F.when(F.size("entity") > 0, names), "best": F.get("source", F.lit(0))})
    none = F.array(F.lit(None).cast(facts.schema["entity"].dataType["role"].dataType))
    roles = lambda i, j: F.array_except(F.slice("entity", i + 1, F.coalesce(F.get("names", j + 1), F.size("entity")) - i)["role"], none)
    parts = {
        "members": ("member", F.array_distinct("member")),
        "entities": ("entity", F.transform("names", lambda i, j: F.struct(F.get("entity", i)["entity"].alias("entity"), F.get("entity", i)["name"].alias("name"), roles(i, j).alias("roles")))),
        "reactions": ("stance", F.when(F.col("best").isNotNull(), F.transform(_firsts("stance", "entity", "topic"), lambda x: F.struct(x["entity"], x["topic"], x["stance"], F.col("best.tier"), F.col("best.url"))))),
        "sources": ("source", F.arrays_zip("source.tier", "source.url", "source.span")),
        "races": ("race", F.sort_array(F.transform(_firsts("race", "race_id"), lambda x: F.struct(x["down"], x["race_id"], x["rating"], x["confidence"])))),
    }
    rows = rows.select("head", *[F.when(F.size(old) > 0, v).alias(k) for k, (old, v) in parts.items()])
    rows = rows.withColumn("races", F.arrays_zip("races.race_id", "races.rating", "races.confidence"))
    return heads.join(rows, "head", "left").join(_listed(related, "head", "related", [F.col("ts"), F.col("other"), F.col("way")], ["other", "way", "relation"]), "head", "left")


def related_both_ways(links: DataFrame, at: tuple[str, str] | None = None) -> DataFrame:
    """links (src, dst, relation, sim) from either head: head, other, way (W5); with `at`, the columns of links
    that hold the times of src and dst, also ts, that of the other."""
    end = lambda head, other, way, ts: F.struct(F.col(head).alias("head"), F.col(other).alias("other"), F.lit(way).alias("way"), *([F.col(ts).alias("ts")] if ts else []))
    src, dst = at or (None, None)
    return links.select(F.explode(F.array(end("src", "dst", "prior", dst), end("dst", "src", "later", src))).alias("e"), "relation", "sim").select("e.*", "relation", "sim")


def dossier(stances: DataFrame, events: DataFrame, sources: DataFrame, newest: int = 20, neighbours: DataFrame | None = None) -> DataFrame:
    """Per entity: latest stance for each topic, and how many of its newest events have a source.  The
    limit comes before sourceless events go (W8).  events: entity, head, ts, role.  With neighbours (rows
    of graph.neighbourhood) there are relationships, the surest and most frequent first."""
    latest = first_per_key(stances, ["entity", "topic"], F.desc("ts"), F.desc("head")).groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.col("topic").cast("string"), "stance"))), ",").alias("stances"))
    seen = events.groupBy("entity", "head").agg(F.max("ts").alias("ts"), F.sort_array(F.collect_set("role")).alias("roles"))
    top = seen.withColumn("rank", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("ts"), F.desc("head")))).where(F.col("rank") <= newest)
    shown = top.join(sources.select("head").distinct(), "head", "left_semi").groupBy("entity").agg(F.count(F.lit(1)).alias("shown"), F.max("ts").alias("newest"))
    out = latest.join(shown, "entity", "full")
    if neighbours is None:
        return out
    order = [-F.col("confidence"), -F.col("edge_count"), F.col("neighbour"), F.col("relation"), F.col("direction")]
    return out.join(_listed(neighbours, "entity", "relationships", order, ["direction", "relation", "neighbour", "edge_count", "confidence"]), "entity", "full")


def race_dossiers(races: DataFrame, history: DataFrame, entities: DataFrame, polls: DataFrame, links: DataFrame, sources: DataFrame, newest: int = 20) -> DataFrame:
    """One row per race (race_id, rating, incumbent: bioguide id, candidate_ids: FEC ids in order) with its
    ratings, newest first; the incumbent's entity; its candidates in order, each with the first entity that
    has or lists its id; the latest poll; and of its newest linked heads those with a source (W9).
    history: race_id, rater, rating, asof; entities: entity_id, canonical_id, aliases; polls: race_id, id,
    asof, value; links: race_id, head, ts, confidence; sources: head, id, tier, url."""
    ratings = _listed(history, "race_id", "ratings", [-F.unix_date("asof"), F.col("rater")], ["rater", "rating", "asof"])
    known = entities.select("entity_id", "canonical_id", "aliases")
    sits = races.where("incumbent is not null").select("race_id", F.concat(F.lit("bioguide:"), "incumbent").alias("canonical_id")).join(known.select("canonical_id", F.col("entity_id").alias("incumbent_id")), "canonical_id").select("race_id", "incumbent_id")
    each = races.select("race_id", F.posexplode("candidate_ids").alias("at", "fec"))
    by_id = known.select(F.explode(F.array_union(F.array(F.when(F.col("canonical_id").startswith("fec:"), F.substring_index("canonical_id", ":", -1))), F.coalesce("aliases", F.array().cast("array<string>")))).alias("fec"), "entity_id").where("fec is not null")
    first = by_id.groupBy("fec").agg(F.min("entity_id").alias("entity_id"))
    runs = _listed(each.join(first, "fec", "left"), "race_id", "candidates", [F.col("at")], ["fec", "entity_id"])
    poll = first_per_key(polls, ["race_id"], F.desc("asof"), F.desc("id")).select("race_id", F.struct("asof", "value").alias("poll"))
    top = links.withColumn("rank", F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("confidence"), F.desc("ts"), F.desc("head")))).where(F.col("rank") <= newest)
    shown = top.join(top_source(sources).select("head", "tier", "url"), "head")
    events = _listed(shown, "race_id", "events", [F.col("rank")], ["head", "confidence", "tier", "url"])
    out = races
    for part in (ratings, sits, runs, poll, events):
        out = out.join(part, "race_id", "left")
    return out


def ticker(series: DataFrame, prefer: tuple[str, ...]) -> DataFrame:
    """series (series_id, source, asof, value) as the latest level, change and yearly percent of each
    (W10): the year earlier must be the same day, the first source in `prefer` that has it wins, and
    series too short are left out."""
    w = Window.partitionBy("series_id", "source").orderBy("asof")
    rows = series.withColumn("previous", F.lag("value").over(w)).withColumn("last", F.row_number().over(Window.partitionBy("series_id", "source").orderBy(F.desc("asof"))))
    year = series.select("series_id", "source", F.add_months("asof", 12).alias("asof"), F.col("value").alias("year_ago"), F.col("asof").alias("was")).where(F.dayofmonth("asof") == F.dayofmonth("was")).drop("was")
    now = rows.where("last = 1 and previous is not null").join(year, ["series_id", "source", "asof"])
    out = now.withColumn("yoy", F.round((F.try_divide("value", F.col("year_ago")) - 1) * 100, 4)).where("yoy is not null")
    rank = F.array_position(F.array(*[F.lit(p) for p in prefer]), F.col("source"))
    return first_per_key(out, ["series_id"], F.when(rank == 0, len(prefer) + 1).otherwise(rank), F.col("source")).select("series_id", "source", "asof", F.col("value").alias("level"), F.round(F.col("value") - F.col("previous"), 4).alias("change"), "yoy")


def indicator_ticker(series: DataFrame, kinds: DataFrame, prefer: tuple[str, ...] = SOURCE_PREFERENCE) -> DataFrame:
    """series (series_id, source, asof, value decimal) by kinds (series_id, kind: level, change or yoy) as
    series_id, kind, source, asof, value, delta (against the observation before, of the same kind) and
    span, the observations that value comes from (W10).  A change needs the observation before, a yearly
    one that of the same day a year before; the first source in `prefer` whose latest value has what it
    needs wins, and series without one are left out."""
    w = Window.partitionBy("series_id", "source").orderBy("asof")
    rows = series.join(kinds, "series_id").withColumn("before", F.lag(F.struct("asof", "value")).over(w))
    year = series.select("series_id", "source", F.add_months("asof", 12).alias("asof"), F.struct(F.col("asof"), F.col("value")).alias("year"))
    rows = rows.join(year.where(F.dayofmonth("asof") == F.dayofmonth("year.asof")), ["series_id", "source", "asof"], "left")
    level, change = F.col("value").cast("double"), (F.col("value") - F.col("before.value")).cast("double")
    yoy = (F.try_divide(F.col("value").cast("double"), F.col("year.value").cast("double")) - 1) * 100
    shown = F.when(F.col("kind") == "level", level).when(F.col("kind") == "change", change).otherwise(yoy)
    used = F.when(F.col("kind") == "change", F.col("before")).when(F.col("kind") == "yoy", F.col("year"))
    said = lambda x: F.when(x.isNotNull(), F.concat(F.col("series_id"), F.lit(" "), x["asof"].cast("string"), F.lit(" = "), x["value"].cast("string")))
    rows = rows.withColumn("shown", shown).withColumn("span", F.concat_ws("; ", said(used), said(F.struct("asof", "value"))))
    rows = rows.withColumn("delta", F.col("shown") - F.lag("shown").over(w))
    last = rows.withColumn("rank", F.row_number().over(Window.partitionBy("series_id", "source").orderBy(F.desc("asof")))).where("rank = 1 and shown is not null")
    place = F.array_position(F.array(*[F.lit(p) for p in prefer]), F.col("source"))
    first = first_per_key(last.where(place > 0), ["series_id"], place)
    return first.select("series_id", "kind", "source", "asof", F.round("shown", 4).alias("value"), F.round("delta", 4).alias("delta"), "span")


def retrieve(members: DataFrame, query: list[float], named: list[int], members_kept: int = 32, heads: int = KNOBS.rsch_events, least: float = KNOBS.rsch_sim, digits: int = 6) -> DataFrame:
    """members (id, head, ts, embedding) nearest to the query as ranked heads: named ones first, newest
    first, then by similarity (W11)."""
    sim = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), digits)
    scored = members.select("id", "head", "ts", sim.alias("sim"))
    near = scored.orderBy(F.desc("sim"), "id").limit(members_kept).where(F.col("sim") >= least).groupBy("head").agg(F.max("sim").alias("sim"), F.max("ts").alias("ts"))
    asked = scored.where(F.col("head").isin(named)).groupBy("head").agg(F.lit(None).cast("double").alias("sim"), F.max("ts").alias("ts")).orderBy(F.desc("ts"), "head").limit(heads).withColumn("named", F.lit(0))
    both = asked.unionByName(near.join(asked.select("head"), "head", "left_anti").withColumn("named", F.lit(1)))
    order = Window.orderBy("named", F.when(F.col("named") == 0, -epoch_us("ts")), F.desc("sim"), F.desc("ts"), "head")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= heads).select("rank", "head", "named", "sim")


def number_records(records: DataFrame, most: int = KNOBS.rsch_records) -> DataFrame:
    """records (head, place, id, url, span) numbered per head over distinct (url, span), at most `most`
    (W12)."""
    first = first_per_key(records, ["head", "url", "span"], F.col("place"), F.col("id"))
    n = F.row_number().over(Window.partitionBy("head").orderBy("place", "id", "url", "span"))
    return first.withColumn("n", n).where(F.col("n") <= most)


def trend_bins(points: DataFrame, bins: int = 8) -> DataFrame:
    """points (key, id, value) in bins between each key's least and most; 3 where they are equal."""
    w = Window.partitionBy("key")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    return points.withColumns({"lo": lo, "hi": hi}).withColumn("bin", F.when(F.col("hi") == F.col("lo"), 3).otherwise(F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (bins - 1)).cast("int"))).drop("lo", "hi")
