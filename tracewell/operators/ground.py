"""Grounding of extracted rows in their documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.columns import grounded_forms, lookup, number_set, span_form
from tracewell.operators.rows import first_per_key
from tracewell.params import RELEVANT_SOURCES, TIER_WEIGHT


def document_text(author: Column, sponsors: Column, body: Column) -> Column:
    """Header lines, a rule and the body; the body alone without header lines."""
    lines = F.concat(F.filter(F.array(F.when(author != "", F.concat(F.lit("Author: @"), author))), lambda x: x.isNotNull()), F.transform(F.filter(F.coalesce(sponsors, F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.concat(F.lit("Sponsor: "), x)))
    return F.when(F.size(lines) > 0, F.array_join(F.concat(lines, F.array(F.lit("---"), body)), "\n")).otherwise(body)


def ground_spans(spans: DataFrame, docs: DataFrame, **how) -> DataFrame:
    """spans (doc_id, span, ...) with grounded: whether docs (doc_id, text) hold the span (E2).  A text is
    evened out once, before it meets its spans."""
    forms = docs.select("doc_id", span_form(F.col("text"), **how).alias("_form"))
    both = spans.join(forms, "doc_id", "left")
    return both.withColumn("grounded", grounded_forms(span_form(F.col("span"), **how), F.col("_form"))).drop("_form")


def relevance(source: Column, verdict: Column) -> Column:
    """Structured sources always count; others, and documents without a source, as the verdict says."""
    return F.coalesce(source.isin(*RELEVANT_SOURCES), F.lit(False)) | F.coalesce(verdict, F.lit(False))


def validated(rows: DataFrame, column: str, schema: str, *checks: tuple[str, Column]) -> DataFrame:
    """rows with parsed, the typed JSON of the column, and error, the first check that fails or
    'malformed' (E3); the checks see parsed."""
    parsed = rows.withColumn("parsed", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    bad = F.try_parse_json(column).isNull()
    error = F.when(bad, "malformed")
    for name, ok in checks:
        error = error.when(~F.coalesce(ok, F.lit(False)), name)
    return parsed.withColumn("error", error)


def best_mentions(links: DataFrame) -> DataFrame:
    """links (doc_id, entity_id, role, confidence, pos): the most confident per entity and role, the
    first of equal ones; unresolved ones stay (E7)."""
    known = first_per_key(links.where("entity_id is not null"), ["doc_id", "entity_id", "role"], F.desc("confidence"), F.col("pos"))
    return known.unionByName(links.where("entity_id is null"))


def clean_topics(topics: Column, areas: Column) -> Column:
    """struct(topics without repeats, areas that are among them)."""
    return F.struct(F.array_distinct(topics).alias("topics"), F.array_intersect(areas, topics).alias("policy_areas"))


def proposed_edges(edges: DataFrame, payload: DataFrame) -> DataFrame:
    """edges (doc_id, pos, src, relation, dst, grounded) that count: both ends, no loop, no votes,
    grounded, the first of repeats, none that the payload has (E11)."""
    ok = F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & ~F.col("relation").startswith("VOTED_") & F.col("grounded")
    fred = F.col("src").startswith("fred:") | F.col("dst").startswith("fred:")
    ok = ok & (~fred | F.col("relation").isin("CORRELATES_WITH", "EXPOSED_TO"))
    first = first_per_key(edges.where(ok), ["doc_id", "src", "relation", "dst"], F.col("pos"))
    return first.join(payload.select("doc_id", "src", "relation", "dst"), ["doc_id", "src", "relation", "dst"], "left_anti")


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, any_case: bool = False) -> DataFrame:
    """docs (doc_id, text) with lexicon (surface, entity_id) as doc_id, surface, entity_id: whole-word
    hits of surfaces of three letters or more with a capital (E15); with any_case, as for questions,
    capitals do not matter.  A surface can stand only where the rarest of its words does, so documents meet
    surfaces by that word alone, without their texts, and each text is then fetched once, for all surfaces
    that it may hold; a surface that begins with a frequent word costs nothing where its rarest is not."""
    fold = F.lower if any_case else (lambda c: c)
    usable = lexicon.where((F.length("surface") >= 3) & F.col("surface").rlike("[A-Z]")).distinct()
    parts = usable.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("surface")), F.lit(r"(\w+)"), F.lit(1)))))
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("text")), F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    often = words.join(parts.select("word").distinct(), "word").groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    # A word that no document has is the rarest, and meets nothing.
    ranked = parts.join(often, "word", "left").groupBy("surface").agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))
    met = words.join(ranked, "word").groupBy("doc_id").agg(F.collect_set("surface").alias("surfaces"))
    quoted = lambda s: F.concat(F.lit("(?i)" if any_case else ""), F.lit(r"(?<!\w)\Q"), s, F.lit(r"\E(?!\w)"))
    held = lambda s: F.contains(fold(F.col("text")), fold(s)) & F.regexp_like("text", quoted(s))
    found = docs.select("doc_id", "text").join(met, "doc_id").select("doc_id", F.explode(F.filter("surfaces", held)).alias("surface"))
    return found.join(usable.select("surface", "entity_id"), "surface").select("doc_id", "surface", "entity_id").distinct()


def claim_problems(claims: DataFrame, records: DataFrame) -> DataFrame:
    """claims (claim_id, text, cited: array of n) against records (n, body) as claim_id, problem,
    extra: 'no citations', 'unknown records', 'numbers' that the cited records lack, or null (E16, E18)."""
    cited = claims.select("claim_id", F.explode_outer("cited").alias("n")).join(records.select("n", "body"), "n", "left")
    corpus = cited.groupBy("claim_id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("body"))).alias("corpus"), F.count("n").alias("cites"), F.count("body").alias("known"))
    both = claims.join(corpus, "claim_id").withColumn("extra", F.sort_array(F.array_except(number_set(F.col("text")), number_set(F.col("corpus")))))
    problem = F.when(F.col("cites") == 0, "no citations").when(F.col("known") < F.col("cites"), "unknown records").when(F.size("extra") > 0, "numbers")
    return both.select("claim_id", problem.alias("problem"), F.when(problem == "numbers", F.array_join("extra", ",")).otherwise(F.lit("")).alias("extra"))


def prose_problems(prose: DataFrame, spans: DataFrame, named: DataFrame, cast: DataFrame) -> DataFrame:
    """prose (head, text, cited: array of n) against its numbered spans (head, n, span), the entities that it
    names (head, entity_id, surface) and those of its cluster (head, entity_id): head, problems (E16),
    sorted: 'no citations', 'citation n', 'number x', 'entity surface'."""
    cited = prose.select("head", F.explode("cited").alias("n")).join(spans, ["head", "n"], "left_anti").select("head", F.concat(F.lit("citation "), F.col("n").cast("string")).alias("problem"))
    none = prose.where(F.size("cited") == 0).select("head", F.lit("no citations").alias("problem"))
    said = spans.groupBy("head").agg(F.concat_ws("\n", F.sort_array(F.collect_list("span"))).alias("corpus"))
    both = prose.select("head", "text").join(said, "head", "left")
    extra = both.select("head", F.explode(F.array_except(number_set(F.col("text")), number_set(F.coalesce("corpus", F.lit(""))))).alias("x")).select("head", F.concat(F.lit("number "), "x").alias("problem"))
    # An entity is at home in the cluster, or in the words of its spans.
    strange = named.join(cast.select("head", "entity_id"), ["head", "entity_id"], "left_anti").join(said, "head", "left")
    strange = strange.where(~F.contains(F.coalesce("corpus", F.lit("")), F.col("surface"))).select("head", F.concat(F.lit("entity "), "surface").alias("problem"))
    every = none.unionByName(cited).unionByName(extra).unionByName(strange)
    found = every.groupBy("head").agg(F.sort_array(F.collect_set("problem")).alias("problems"))
    return prose.select("head").join(found, "head", "left").select("head", F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def answers(claims: DataFrame, problems: DataFrame, insufficient: DataFrame) -> DataFrame:
    """Claims (answer_id, claim_id, text) without a problem (claim_id, problem), one row each, and one refusal
    row (claim_id null) for answers that keep none or are marked insufficient (answer_id) (E18)."""
    good = claims.join(problems.where("problem is null").select("claim_id"), "claim_id", "left_semi").join(insufficient.select("answer_id"), "answer_id", "left_anti")
    kept = good.select("answer_id", "claim_id", "text", F.lit(False).alias("refused"))
    every = claims.select("answer_id").unionByName(insufficient.select("answer_id")).distinct()
    refused = every.join(good.select("answer_id"), "answer_id", "left_anti").select("answer_id", F.lit(None).cast(claims.schema["claim_id"].dataType).alias("claim_id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("refused"))
    return kept.unionByName(refused)


def answer_confidence(kept: DataFrame, records: DataFrame, totals: DataFrame) -> DataFrame:
    """kept (answer_id, claim_id, n) and totals (answer_id, claims) as answer_id, confidence: mean over
    kept claims of the mean trust weight times event confidence, times the share kept (E19)."""
    weight = lookup(TIER_WEIGHT, F.col("trust_tier")) * F.col("event_confidence")
    claims = kept.join(records, "n").groupBy("answer_id", "claim_id").agg(F.avg(weight).alias("own"))
    per = claims.groupBy("answer_id").agg(F.avg("own").alias("mean"), F.count(F.lit(1)).alias("n_kept"))
    value = F.round(F.col("mean") * F.try_divide(F.col("n_kept"), F.col("claims")), 3)
    return totals.join(per, "answer_id", "left").select("answer_id", F.coalesce(value, F.lit(0.0)).alias("confidence"))


def fallback(members: DataFrame) -> DataFrame:
    """members (head, member_id, tier, confidence, headline, what_happened): the text of each head's best
    member, by tier, confidence and id (E17)."""
    best = F.min_by(F.struct("headline", "what_happened"), F.struct("tier", -F.col("confidence"), "member_id"))
    return members.groupBy("head").agg(best.alias("best")).select("head", "best.*", F.lit(None).cast("string").alias("why_it_matters"))
