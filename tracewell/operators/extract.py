"""From documents and the outputs of extraction passes to events (E4-E6, E9, E10, E12, E13) and the
ledger of runs (D9, D11, D16).

A pass's output arrives as rows; these operators validate, ground, deduplicate and fan them out.  A
document that fails is a row with an error, never an exception, so one bad document costs no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import grounded_forms, lookup, span_form
from tracewell.operators.ground import relevance
from tracewell.operators.registry import with_states
from tracewell.operators.rows import first_per_key
from tracewell.params import SOURCE_TIER, STANCE_HOLDERS

REVIEW = ("doc_id", "kind", "mention", "field", "payload", "confidence")


def with_grounding(rows: DataFrame, docs: DataFrame, *columns: str, **how) -> DataFrame:
    """rows (doc_id, ...) with <column>_ok for each column: whether the text of docs (doc_id, text) holds
    it.  A document's text is evened out once, for all its rows."""
    needed = rows.select("doc_id").distinct()
    forms = docs.select("doc_id", "text").join(needed, "doc_id", "left_semi").select("doc_id", span_form(F.col("text"), **how).alias("_form"))
    both = rows.join(forms, "doc_id", "left")
    for c in columns:
        both = both.withColumn(f"{c}_ok", grounded_forms(span_form(F.col(c), **how), F.col("_form")))
    return both.drop("_form")


def gate(docs: DataFrame, verdicts: DataFrame, least: float = 0.6) -> DataFrame:
    """docs (doc_id, source, url) with verdicts (doc_id, relevant, confidence, reason) as doc_id, relevant,
    confidence, dropped_reason, review: structured sources are relevant with confidence 1; a document
    dropped with little confidence goes to review (E4)."""
    told = docs.select("doc_id", "source").join(verdicts.select("doc_id", "relevant", "confidence", "reason"), "doc_id", "left")
    structured = relevance(F.col("source"), F.lit(False))
    relevant = relevance(F.col("source"), F.col("relevant"))
    sure = F.when(structured, F.lit(1.0)).otherwise(F.col("confidence"))
    reason = F.when(~relevant, F.coalesce("reason", F.lit("no verdict")))
    return told.select("doc_id", relevant.alias("relevant"), sure.alias("confidence"), reason.alias("dropped_reason"), (~relevant & F.coalesce(sure < least, F.lit(True))).alias("review"))


def event_cores(outputs: DataFrame, docs: DataFrame, **how) -> DataFrame:
    """outputs (doc_id, span, event_time, jurisdiction, ...) with docs (doc_id, text, event_time) as outputs
    with jurisdiction 'federal', 'fips:NN' or null, the document's own time before the output's, and
    error 'ungrounded' where the text does not hold the span (E5)."""
    seen = with_grounding(outputs, docs, "span", **how)
    own = docs.select("doc_id", F.col("event_time").alias("_own_time"))
    placed = with_states(seen.join(own, "doc_id", "left"), "jurisdiction")
    where = F.when(F.lower(F.trim("jurisdiction")) == "federal", "federal").otherwise(F.concat(F.lit("fips:"), "fips"))
    placed = placed.withColumn("jurisdiction", where).withColumn("event_time", F.coalesce("_own_time", "event_time"))
    return placed.withColumn("error", F.when(~F.col("span_ok"), "ungrounded")).drop("_own_time", "fips", "abbrev", "state_name", "span_ok")


def mention_links(mentions: DataFrame, docs: DataFrame, resolved: DataFrame, **how) -> DataFrame:
    """mentions (mention_id, doc_id, mention, role, span, entity_type, confidence) whose span and mention
    the text holds, with entity_id, method and confidence from resolved (mention_id, entity_id, method,
    confidence): the lesser of both, to 4 places; unresolved ones keep their own (E6)."""
    held = with_grounding(mentions, docs, "span", "mention", **how).where("span_ok and mention_ok").drop("span_ok", "mention_ok")
    found = resolved.select("mention_id", "entity_id", "method", F.col("confidence").alias("_sure"))
    both = held.join(found, "mention_id", "left")
    sure = F.when(F.col("entity_id").isNull(), F.col("confidence")).otherwise(F.round(F.least("confidence", "_sure"), 4))
    return both.withColumn("confidence", sure).withColumn("method", F.coalesce("method", F.lit("none"))).drop("_sure")


def stance_rows(stances: DataFrame, docs: DataFrame, links: DataFrame, topics: DataFrame, **how) -> DataFrame:
    """stances (doc_id, pos, entity_id, topic, position, intensity, span, confidence) that count (E9): not of
    bills and votes (docs: doc_id, kind, text; a document without a kind is neither), by an entity of the document that may hold stances
    (links: doc_id, entity_id, entity_type), on a topic of it (topics: doc_id, topic), with a span that
    the text holds; per entity and topic the surest, the first of equal ones."""
    open_docs = docs.where(~F.coalesce(F.col("kind").isin("bill", "vote"), F.lit(False))).select("doc_id")
    holders = links.where(F.col("entity_type").isin(*STANCE_HOLDERS)).select("doc_id", "entity_id").distinct()
    asked = stances.join(open_docs, "doc_id", "left_semi").join(holders, ["doc_id", "entity_id"], "left_semi").join(topics.select("doc_id", "topic").distinct(), ["doc_id", "topic"], "left_semi")
    held = with_grounding(asked, docs, "span", **how).where("span_ok").drop("span_ok")
    return first_per_key(held, ["doc_id", "entity_id", "topic"], F.desc("confidence"), F.col("pos"))


def payload_edges(docs: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """Edges that payloads state (E10): the sponsor of a bill proposes it, members vote for or against the
    bill of a vote: doc_id, src, relation, dst, confidence 1.  docs: doc_id, kind, bill_entity (null: no
    edge); members: doc_id, entity_id, cast_str; links: doc_id, entity_id, role."""
    bill = docs.where("bill_entity is not null").select("doc_id", "kind", F.col("bill_entity").alias("dst"))
    vote = lookup({"Yea": "VOTED_FOR", "Nay": "VOTED_AGAINST"}, F.col("cast_str"))
    votes = members.join(bill.where("kind = 'vote'"), "doc_id").select("doc_id", F.col("entity_id").alias("src"), vote.alias("relation"), "dst")
    sponsors = links.where("role = 'sponsor'").join(bill.where("kind = 'bill'"), "doc_id").select("doc_id", F.col("entity_id").alias("src"), F.lit("PROPOSES").alias("relation"), "dst")
    return votes.unionByName(sponsors).where("relation is not null and src is not null").distinct().withColumn("confidence", F.lit(1.0))


def low_confidence_review(rows: DataFrame, field: Column, mention: Column, payload: Column, least: float = 0.6) -> DataFrame:
    """Rows (doc_id, confidence) below least as review rows; the rows themselves stay."""
    return rows.where(F.col("confidence") < least).select("doc_id", F.lit("low_confidence").alias("kind"), mention.alias("mention"), field.alias("field"), F.to_json(payload).alias("payload"), "confidence")


def events_of(docs: DataFrame, cores: DataFrame, topics: DataFrame) -> DataFrame:
    """One event per document with a core that has no error (E13): doc_id, event_type, headline,
    what_happened, event_time (or else when it was fetched), confidence, topics, jurisdiction.
    docs: doc_id, fetched_at; topics: doc_id, topics."""
    what = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("actor_mention", "action", "object")])
    both = cores.where("error is null").join(docs.select("doc_id", "fetched_at"), "doc_id").join(topics.select("doc_id", "topics"), "doc_id", "left")
    return both.select("doc_id", "event_type", "headline", F.nullif(what, F.lit("")).alias("what_happened"), F.coalesce("event_time", "fetched_at").alias("event_time"), "confidence", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "jurisdiction")


def event_sources(docs: DataFrame, cores: DataFrame) -> DataFrame:
    """The source of each event (E13): doc_id, url, span, trust_tier, claim.  docs: doc_id, url,
    source_type."""
    tier = lookup(SOURCE_TIER, F.col("source_type"))
    return cores.where("error is null").select("doc_id", "span", "headline").join(docs.select("doc_id", "url", "source_type"), "doc_id").select("doc_id", "url", "span", tier.alias("trust_tier"), F.col("headline").alias("claim"))


def event_entities(links: DataFrame, stances: DataFrame) -> DataFrame:
    """The mention and stance rows of events (E13): doc_id, entity_id, role, topic ('' for mentions), stance,
    intensity, span, confidence."""
    named = links.where("entity_id is not null").select("doc_id", "entity_id", "role", F.lit("").alias("topic"), F.lit(None).cast("string").alias("stance"), F.lit(None).cast("double").alias("intensity"), "span", "confidence")
    held = stances.select("doc_id", "entity_id", F.lit("actor").alias("role"), "topic", F.col("position").alias("stance"), "intensity", "span", "confidence")
    return named.unionByName(held)


def run_ledger(ledger: DataFrame, attempts: DataFrame) -> DataFrame:
    """The ledger (item_id, attempt, status, error) after attempts of the same columns: one row per item; the
    latest attempt of an item whose row is failed or missing replaces it, finished rows stay (D9)."""
    done = ledger.where("status <> 'FAILED'")
    latest = first_per_key(attempts.join(done.select("item_id"), "item_id", "left_anti"), ["item_id"], F.desc("attempt"))
    return ledger.join(latest.select("item_id"), "item_id", "left_anti").unionByName(latest.select(*ledger.columns))


def review_inserts(stored: DataFrame, incoming: DataFrame, *order: Column) -> DataFrame:
    """incoming review rows to insert: the first of each (doc_id, kind, mention, field) that is not stored
    (D11)."""
    key = ["doc_id", "kind", "mention", "field"]
    return first_per_key(incoming, key, *order).join(stored.select(*key), key, "left_anti")


def open_reviews(stored: DataFrame, inserted: DataFrame) -> DataFrame:
    """n: the number of review rows that are open after the insert (D11).  stored: ..., resolved boolean."""
    return stored.where("not resolved").select("doc_id").unionByName(inserted.select("doc_id")).agg(F.count(F.lit(1)).alias("n"))


def batch_counts(rows: DataFrame, source: str, error: Column, known: Column) -> DataFrame:
    """Per source: fetched, inserted, skipped (known) and failed rows (D16); failed ones count nowhere
    else."""
    bad = error.isNotNull()
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~bad & ~known).alias("inserted"), F.count_if(~bad & known).alias("skipped"), F.count_if(bad).alias("failed"))
