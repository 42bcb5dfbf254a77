"""Lookups in the registry of entities and what is minted in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import bill_id, bill_label, lookup, make_id, series_id, split_id, state_key, vote_bill_id
from tracewell.operators.rows import first_per_key
from tracewell.params import KNOBS, SEARCH_TYPES, STATES, TYPE_IMPORTANCE


def state_table(spark: SparkSession) -> DataFrame:
    """fips, abbrev, name: a row per state, a fixed table."""
    return spark.createDataFrame(list(STATES), "fips string, abbrev string, name string")


def with_states(rows: DataFrame, column: str) -> DataFrame:
    """rows with fips, abbrev and state_name of the state that the column names by name, postal code
    or FIPS code; null where it names none (R3)."""
    states = state_table(rows.sparkSession)
    keys = states.select(F.explode(F.array(state_key(F.col("name")), F.lower("abbrev"), F.col("fips"))).alias("_key"), "fips", "abbrev", F.col("name").alias("state_name"))
    # A fixed table of three keys a state.
    return rows.withColumn("_key", state_key(F.col(column))).join(F.broadcast(keys), "_key", "left").drop("_key")


def with_series(rows: DataFrame, column: str, series: DataFrame) -> DataFrame:
    """rows with series_id, the registered series that the column names, else null."""
    known = series.select(F.col("series_id").alias("_series")).distinct()
    named = rows.withColumn("_named", series_id(F.col(column)))
    return named.join(known, named["_named"] == F.col("_series"), "left").withColumn("series_id", F.col("_series")).drop("_named", "_series")


def by_canonical_id(rows: DataFrame, column: str, namespace: str, entities: DataFrame) -> DataFrame:
    """rows with entity_id of the entity (entity_id, canonical_id) of the raw id in the column, trimmed and
    in capitals; null for malformed and unknown ids (R11)."""
    known = entities.select(F.col("canonical_id").alias("_id"), "entity_id")
    return rows.withColumn("_id", make_id(namespace, F.upper(F.trim(column)))).join(known, "_id", "left").drop("_id")


def by_fec_id(rows: DataFrame, column: str, entities: DataFrame) -> DataFrame:
    """rows with entity_id by FEC id: the entity (entity_id, canonical_id, fec_ids) of its own, else the
    incumbent, the first by entity_id, who holds it (R10)."""
    raw = F.upper(F.trim(column))
    named = rows.withColumn("_fec", F.when(make_id("fec", raw).isNotNull(), raw))
    own = entities.where(F.col("canonical_id").startswith("fec:")).select(F.substring_index("canonical_id", ":", -1).alias("_fec"), F.col("entity_id").alias("_own"))
    holds = entities.select(F.explode("fec_ids").alias("_fec"), "entity_id").groupBy("_fec").agg(F.min("entity_id").alias("_holder"))
    found = named.join(own, "_fec", "left").join(holds, "_fec", "left")
    return found.withColumn("entity_id", F.coalesce("_own", "_holder")).drop("_fec", "_own", "_holder")


def search_scope(mentions: DataFrame, column: str = "entity_type") -> DataFrame:
    """mentions once for each node type that a mention of their type may mean: node_type."""
    types = F.create_map(*[x for k, v in SEARCH_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])[F.col(column)]
    return mentions.withColumn("node_type", F.explode(F.coalesce(types, F.array(column))))


def owners_in_scope(mentions: DataFrame, nodes: DataFrame, key: str, column: str = "entity_type") -> DataFrame:
    """key, owners: how many of nodes (node, name, node_type) own the name of each mention (key, name, entity_type) within
    the types that it may mean (R12).  Nodes are counted by name and type before mentions meet them, so a name that
    many mention and many own makes no pairs."""
    owned = nodes.groupBy("name", "node_type").agg(F.count("node").alias("owned"))
    met = search_scope(mentions, column).join(owned, ["name", "node_type"], "left")
    return met.groupBy(key).agg(F.coalesce(F.sum("owned"), F.lit(0)).cast("long").alias("owners"))


def bill_of(docs: DataFrame) -> DataFrame:
    """docs (doc_id, kind, congress, type, number, bill_number, ...) with bill_id: that of bills by type
    and number, of votes by the number that they name, null for other kinds."""
    by_kind = F.when(F.col("kind") == "bill", bill_id(F.col("congress"), F.col("type"), F.col("number"))).when(F.col("kind") == "vote", vote_bill_id(F.col("congress"), F.col("bill_number")))
    return docs.withColumn("bill_id", by_kind)


def minted_bills(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Bills that documents (bill_id, title, url, doc_id) name as rows to insert or update: canonical_id,
    name, aliases, url, change (R13).  A new bill is named by its first document; a title, the first that
    comes, fills the name of one that is known, or first seen, by its label alone."""
    label = bill_label(F.col("bill_id"))
    seen = docs.where("bill_id is not null").groupBy("bill_id").agg(F.min_by("url", "doc_id").alias("url"), F.min(F.when(F.length("title") > 0, F.struct("doc_id", "title"))).alias("titled"))
    named = seen.select(F.col("bill_id").alias("canonical_id"), label.alias("label"), "url", F.col("titled.title").alias("title"))
    full = F.when(F.col("title").isNotNull(), F.concat_ws(": ", "label", "title")).otherwise(F.col("label"))
    both = named.join(entities.select("canonical_id", F.col("name").alias("had")), "canonical_id", "left")
    change = F.when(F.col("had").isNull(), "insert").when((F.col("had") == F.col("label")) & F.col("title").isNotNull(), "update")
    aliases = F.array("label", F.substring_index("label", " (", 1))
    return both.select("canonical_id", full.alias("name"), aliases.alias("aliases"), "url", change.alias("change")).where("change is not null")


def connector_links(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that documents (doc_id, kind, url, body, author, sponsors, resolved: canonical ids,
    bill_id) name by id, with role, span and confidence 1 (R14): doc_id, entity_id, canonical_id, role,
    span, confidence.  Ids without an entity are passed over."""
    first = F.coalesce(F.nullif(F.element_at(F.split(F.coalesce("body", F.lit("")), r"\r?\n"), 1), F.lit("")), F.col("url"))
    lines = docs.select("doc_id", "kind", "bill_id", "resolved", first.alias("first"), F.when(F.length("author") > 0, F.concat(F.lit("Author: @"), "author")).alias("author"), F.concat(F.lit("Sponsor: "), F.try_element_at("sponsors", F.lit(1))).alias("sponsor"))
    each = lines.withColumn("canonical_id", F.explode("resolved"))
    member = split_id(F.col("canonical_id"))["namespace"] == "bioguide"
    role = F.when(member & (F.col("kind") == "vote"), "voter").when(member & (F.col("kind") == "bill"), "sponsor").when(member & F.col("author").isNotNull(), "author").otherwise("subject")
    span = F.when(role == "sponsor", F.coalesce("sponsor", "first")).when(role == "author", F.col("author")).otherwise(F.col("first"))
    each = each.withColumn("role", role).withColumn("span", span).select("doc_id", "canonical_id", "role", "span")
    bills = lines.where("bill_id is not null").select("doc_id", F.col("bill_id").alias("canonical_id"), F.lit("subject").alias("role"), F.col("first").alias("span"))
    every = each.unionByName(bills)
    # FEC ids may be held by an incumbent's entity.
    fec = by_fec_id(every.where(F.col("canonical_id").startswith("fec:")).withColumn("raw", F.substring_index("canonical_id", ":", -1)), "raw", entities).drop("raw")
    other = every.where(~F.col("canonical_id").startswith("fec:")).join(entities.select("canonical_id", "entity_id"), "canonical_id", "left")
    return fec.unionByName(other).where("entity_id is not null").select("doc_id", "entity_id", "canonical_id", "role", "span", F.lit(1.0).alias("confidence"))


def unresolved_review(links: DataFrame, candidates: DataFrame) -> DataFrame:
    """links (doc_id, mention_id, mention, entity_type, role, span, confidence, entity_id) without an entity
    as review rows (R15): doc_id, kind, mention, field, entity_type_hint, candidates (those of
    candidates (mention_id, entity_id, score), best first), payload, confidence."""
    best = candidates.groupBy("mention_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "entity_id", "score"))).alias("c"))
    best = best.select("mention_id", F.transform("c", lambda x: F.struct(x["entity_id"].alias("entity_id"), x["score"].alias("score"))).alias("candidates"))
    open_ones = links.where("entity_id is null").join(best, "mention_id", "left")
    return open_ones.select("doc_id", F.lit("unresolved_mention").alias("kind"), "mention", F.lit("entities").alias("field"), F.col("entity_type").alias("entity_type_hint"), F.coalesce("candidates", F.array().cast("array<struct<entity_id:bigint,score:double>>")).alias("candidates"), F.to_json(F.struct("role", "span")).alias("payload"), "confidence")


def current_names(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """entities (canonical_id, name) after changes (canonical_id, name, change)."""
    rows = entities.select("canonical_id", "name", F.lit(1).alias("rank")).unionByName(changes.select("canonical_id", "name", F.lit(0).alias("rank")))
    return first_per_key(rows, ["canonical_id"], F.col("rank"), F.col("name")).drop("rank")


def importance(entities: DataFrame, races: DataFrame) -> DataFrame:
    """entities (entity_id, canonical_id, entity_type, stored) with importance (G9): what is stored above
    0, else 1 for incumbents of races (incumbent: bioguide id), else that of the type, else 0.4."""
    sitting = races.where("incumbent is not null").select(F.concat(F.lit("bioguide:"), "incumbent").alias("canonical_id"), F.lit(KNOBS.incumbent_importance).alias("sitting")).distinct()
    prior = lookup(TYPE_IMPORTANCE, F.col("entity_type"), KNOBS.default_importance)
    value = F.coalesce(F.when(F.col("stored") > 0, F.col("stored")), F.col("sitting"), prior)
    return entities.join(sitting, "canonical_id", "left").withColumn("importance", value).drop("sitting")
