"""Numeric claims in sentences (V4-V8): what is claimed, of which series, for which month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import first_hit, lookup
from tracewell.params import KNOBS, SERIES_KIND

# The grammar of claims.
PERCENT = r"(?i)\b(rose|increased|climbed|jumped|surged|gained|advanced|accelerated|up|fell|declined|dropped|decreased|slipped|down|hit|was|is|at|of|to)\s+(?:by\s+|to\s+|a\s+)?(\d+(?:\.\d+)?)\s*(?:%|percent\b|per\s+cent\b)"
JOBS = r"(?i)\b(added|gained|created|lost|shed|cut)\s+(?:a\s+net\s+|about\s+|roughly\s+|nearly\s+|just\s+)?(\d[\d,]*(?:\.\d+)?)\s*(thousand|million|k\b)?\s+(?:\w+\s+)?jobs\b"
FALLING = ("fell", "declined", "dropped", "decreased", "slipped", "down", "lost", "shed", "cut")
YEARLY = r"(?i)from a year (?:ago|earlier)|over the (?:past|last|prior) (?:12|twelve) months|year[- ]over[- ]year|\byoy\b|\bannual(?:ly)?\b|12-month"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH = rf"(?i)\b({'|'.join(MONTHS)})\b(?:,?\s+(\d{{4}}))?"


def alias_length(span: Column, alias: Column) -> Column:
    """Length of the alias if the span names it as whole words in any case, else 0."""
    quoted = F.concat(F.lit(r"(?i)(?<!\w)\Q"), alias, F.lit(r"\E(?!\w)"))
    return F.when(F.regexp_like(span, quoted), F.length(alias)).otherwise(0)


def claim_period(span: Column, event_time: Column, verb_may: bool = True) -> Column:
    """First day of the month named in the span (its year, or else the last such month up to the
    event's), or of the month before the event.  verb_may=False ignores a month without a capital."""
    pattern = MONTH if verb_may else MONTH.replace("(?i)", "(?=[A-Z])(?i)")
    name, year = F.lower(first_hit(span, pattern, 1)), F.try_to_number(F.nullif(F.coalesce(first_hit(span, pattern, 2), F.lit("")), F.lit("")), F.lit("9999")).cast("int")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int")
    last = F.year(event_time) - F.when(month <= F.month(event_time), 0).otherwise(1)
    return F.when(name.isNull(), F.add_months(F.trunc(event_time, "month"), -1)).otherwise(F.make_date(F.coalesce(year, last), month, F.lit(1)))


def parse_claims(spans: DataFrame, aliases: DataFrame) -> DataFrame:
    """spans (span_id, span, event_time) with aliases (series_id, alias): at most one claim a span, of
    the series whose alias is longest, then the smallest series, that parses: span_id, series_id, kind,
    claimed, yoy, period, text."""
    known = aliases.withColumn("kind", lookup(SERIES_KIND, F.col("series_id"))).where(F.col("kind").isNotNull())
    # Blocking: an alias can only be named where its first word is; the spans themselves are fetched
    # where one is.  Sentences about jobs name their series without an alias, if it is known.
    words = spans.select("span_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("span"), F.lit(r"(\w+)"), F.lit(1)))).alias("word"))
    met = words.join(known.withColumn("word", F.regexp_extract(F.lower("alias"), r"\w+", 0)), "word").select("span_id", "series_id", "kind", "alias")
    named = met.join(spans, "span_id").withColumn("length", alias_length(F.col("span"), F.col("alias")))
    named = named.where("length > 0").select("span_id", "span", "event_time", "series_id", "kind", "length")
    payrolls = "PAYEMS" if known.where("series_id = 'PAYEMS'").limit(1).count() else None
    own = spans.where(F.col("span").rlike(JOBS) & F.lit(payrolls is not None)).select("span_id", "span", "event_time", F.lit(payrolls).cast("string").alias("series_id"), F.lit(SERIES_KIND["PAYEMS"]).alias("kind"), F.lit(0).alias("length"))
    best = named.unionByName(own).groupBy("span_id", "span", "event_time", "series_id", "kind").agg(F.max("length").alias("length"))
    jobs = F.col("kind") == "change_thousands"
    pattern = lambda group: F.when(jobs, first_hit(F.col("span"), JOBS, group)).otherwise(first_hit(F.col("span"), PERCENT, min(group, 2)))
    unit = F.lower(first_hit(F.col("span"), JOBS, 3))
    scale = F.when(~jobs | unit.isin("thousand", "k"), 1.0).when(unit == "million", 1000.0).otherwise(0.001)
    number = F.replace(pattern(2), F.lit(","), F.lit("")).cast("double") * scale
    parsed = best.withColumn("text", pattern(0)).where(F.col("text").isNotNull())
    parsed = parsed.withColumn("claimed", F.when(F.lower(pattern(1)).isin(*FALLING), -number).otherwise(number))
    parsed = parsed.withColumn("yoy", (F.col("kind") == "pct_change") & F.col("span").rlike(YEARLY)).withColumn("period", claim_period(F.col("span"), F.col("event_time")))
    first = F.row_number().over(Window.partitionBy("span_id").orderBy(F.desc("length"), "series_id"))
    return parsed.withColumn("rank", first).where("rank = 1").select("span_id", "series_id", "kind", "claimed", "yoy", "period", "text")


def reference_values(claims: DataFrame, indicators: DataFrame) -> DataFrame:
    """claims with one row for each source that can tell: source, reference.  indicators: series_id,
    asof, source, value; a missing current or prior value drops the source."""
    prior = F.add_months("period", F.when(F.col("yoy"), -12).otherwise(-1))
    now = indicators.select("series_id", F.col("asof").alias("period"), "source", F.col("value").alias("current"))
    then = indicators.select("series_id", F.col("asof").alias("prior"), "source", F.col("value").alias("previous"))
    both = claims.withColumn("prior", prior).join(now, ["series_id", "period"]).join(then, ["series_id", "prior", "source"], "left")
    cur, prev = F.col("current").cast("double"), F.col("previous").cast("double")
    value = F.when(F.col("kind") == "rate", cur).when(F.col("kind") == "pct_change", (F.try_divide(cur, prev) - 1) * 100).otherwise(cur - prev)
    return both.withColumn("reference", value).where(F.col("reference").isNotNull()).drop("prior", "current", "previous")


def tolerance(kind: Column) -> Column:
    return F.when(kind == "change_thousands", KNOBS.tolerance_thousands).otherwise(KNOBS.tolerance_pct) + 1e-9


def claim_outcomes(claims: DataFrame, indicators: DataFrame) -> DataFrame:
    """claims with outcome: no_reference, match if any source is within tolerance, or mismatch; and
    disagree, whether sources differ by more than the tolerance."""
    seen = reference_values(claims, indicators).groupBy("span_id").agg(
        F.bool_or(F.abs(F.col("reference") - F.col("claimed")) <= tolerance(F.col("kind"))).alias("near"),
        (F.max("reference") - F.min("reference") > F.max(tolerance(F.col("kind")))).alias("disagree"),
    )
    out = F.when(F.col("near").isNull(), "no_reference").when(F.col("near"), "match").otherwise("mismatch")
    return claims.join(seen, "span_id", "left").withColumn("outcome", out).withColumn("disagree", F.coalesce("disagree", F.lit(False))).drop("near")
