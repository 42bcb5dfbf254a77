"""Landed payloads to typed rows (S1-S16).  Fetching is not part of this; all start from files or from
a DataFrame of their contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.columns import bill_id, bill_label, lookup, vote_bill_id
from tracewell.operators.registry import state_table, with_states
from tracewell.params import CARD_LABELS, FEED_LABELS, LOOKBACK_DAYS

# Schemas of payloads and label tables.
OBSERVATIONS = "observations array<struct<date:string,value:string>>"
RELEASES = "status string, Results struct<series:array<struct<seriesID:string,data:array<struct<year:string,period:string,value:string>>>>>"
BILL = "congress int, type string, number string, title string, updateDate string, latestAction struct<actionDate:string,text:string>, policyArea struct<name:string>, sponsors array<struct<bioguideId:string,fullName:string,party:string,state:string>>"
ROLL_CALL = "id string, congress int, date string, clerk_rollnumber int, bill_number string, vote_result string, yea_count int, nay_count int, votes array<struct<bioguide_id:string,cast_str:string,member_full:string>>"
POSTS = "data array<struct<id:string,text:string,created_at:string,lang:string>>"
RATINGS = "ratings array<struct<district:string,rating:string,date:string>>"
LEGISLATORS = "id struct<bioguide:string,fec:array<string>>, name struct<first:string,last:string,nickname:string,official_full:string>, terms array<struct<type:string,state:string,class:int,party:string,start:string,end:string>>"


#: Columns of a raw record.
RECORD = {"url": "string", "text": "string", "event_time": "timestamp", "raw_payload": "string", "entity_ids": "array<string>", "unresolved": "array<string>"}


def raw_records(rows: DataFrame) -> DataFrame:
    """rows with any of the columns of RECORD as raw records (S1): all of these columns, absent ones null
    or empty, and only rows with a url."""
    have = {c: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t) for c, t in RECORD.items()}
    lists = {c: F.coalesce(v, F.array().cast(RECORD[c])) if RECORD[c].startswith("array") else v for c, v in have.items()}
    return rows.select(*[v.alias(c) for c, v in lists.items()]).where(F.length("url") > 0)


def observations(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """payloads (series_id, payload JSON) as series_id, asof, value; values that are no numbers, and
    absent ones, go (S2)."""
    each = payloads.select("series_id", F.inline(F.from_json(column, OBSERVATIONS)["observations"]))
    return each.select("series_id", F.to_date("date").alias("asof"), F.expr("try_cast(value as decimal(20,6))").alias("value")).where("value is not null")


def releases(payloads: DataFrame, ids: dict[str, str]) -> DataFrame:
    """payloads (payload JSON) as series_id, asof, value under mapped ids: monthly values only, unknown
    series dropped; a payload whose status is not a success is an error (S3)."""
    body = payloads.select(F.from_json("payload", RELEASES).alias("p"))
    good = F.when(F.col("p.status") == "REQUEST_SUCCEEDED", F.col("p.Results.series")).otherwise(F.raise_error(F.concat(F.lit("request failed: "), F.coalesce("p.status", F.lit("no status")))))
    each = body.select(F.inline(good)).select(lookup(ids, F.col("seriesID")).alias("series_id"), F.inline("data")).where("series_id is not null")
    month = F.when(F.col("period").rlike("^M(0[1-9]|1[0-2])$"), F.substring("period", 2, 2).cast("int"))
    return each.select("series_id", F.make_date(F.col("year").cast("int"), month, F.lit(1)).alias("asof"), F.expr("try_cast(value as decimal(20,6))").alias("value")).where("asof is not null and value is not null")


def lookback(series: DataFrame, since: Column) -> DataFrame:
    """series (series_id, frequency) with the first day to fetch."""
    return series.withColumn("since", F.date_sub(since, lookup(LOOKBACK_DAYS, F.col("frequency"), 180)))


def bills(payloads: DataFrame, politicians: DataFrame, newest: int = 20) -> DataFrame:
    """payloads (payload JSON) of bills as raw records, the newest by update: url key, text, event_time,
    entity_ids of known sponsors, unresolved ones (S4)."""
    b = payloads.select(F.from_json("payload", BILL).alias("b")).select("b.*").orderBy(F.desc("updateDate"), "congress", "type", "number").limit(newest)
    b = b.withColumn("bill_id", bill_id(F.col("congress"), F.col("type"), F.col("number")))
    who = b.select("bill_id", F.inline_outer("sponsors")).join(politicians.select(F.col("bioguide_id").alias("bioguideId"), "entity_id"), "bioguideId", "left")
    who = who.groupBy("bill_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"), F.sort_array(F.collect_set(F.when(F.col("entity_id").isNull(), F.coalesce("bioguideId", "fullName")))).alias("unresolved"))
    text = F.concat_ws("\n", F.concat(bill_label(F.col("bill_id")), F.lit(": "), F.col("title")), F.when(F.col("latestAction.text").isNotNull(), F.concat(F.lit("Latest action: "), F.col("latestAction.text"))))
    return b.join(who, "bill_id", "left").select("bill_id", text.alias("text"), F.to_timestamp("latestAction.actionDate").alias("event_time"), "entity_ids", "unresolved")


def roll_call_index(index: DataFrame, since: str, newest: int = 20) -> DataFrame:
    """index (rollnumber, date) as the newest roll calls on or after since: rollnumber, roll_id."""
    rows = index.where(F.to_date("date") >= F.lit(since).cast("date")).orderBy(F.desc("rollnumber")).limit(newest)
    congress = F.floor((F.year(F.to_date("date")) - 1789) / 2) + 1
    return rows.select("rollnumber", F.concat(F.lit("RS"), congress.cast("string"), _padded(F.col("rollnumber"), 4)).alias("roll_id"))


def _padded(number: Column, least: int) -> Column:
    """A number with leading zeros up to a least length."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(least), F.length(text)), F.lit("0"))


def roll_calls(payloads: DataFrame, politicians: DataFrame) -> DataFrame:
    """payloads (payload JSON) of roll calls as raw records with members in order of id."""
    r = payloads.select(F.from_json("payload", ROLL_CALL).alias("r")).select("r.*")
    session = F.when(F.year(F.to_date("date")) % 2 == 1, 1).otherwise(2)
    votes = r.select("id", F.inline("votes")).join(politicians.select("bioguide_id", "entity_id"), "bioguide_id", "left")
    members = votes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("bioguide_id", "cast_str", "entity_id"))).alias("members"))
    return r.join(members, "id", "left").select("id", session.alias("session"), _padded(F.col("clerk_rollnumber"), 5).alias("clerk"), vote_bill_id(F.col("congress"), F.col("bill_number")).alias("bill_id"), "vote_result", F.to_timestamp("date").alias("event_time"), "members")


def candidates(totals: DataFrame) -> DataFrame:
    """totals (candidate_id, name, race_id, incumbent_challenge, receipts, ...) as one record for each
    valid candidate with receipts: role and the money in words (S7)."""
    ok = F.col("candidate_id").rlike("^[HSP][0-9A-Z]{8}$") & (F.col("receipts") > 0)
    money = F.concat(F.lit("$"), F.format_number(F.col("receipts").cast("double"), 0))
    return totals.where(ok).withColumn("role", F.when(F.col("incumbent_challenge") == "I", "incumbent").otherwise("candidate")).withColumn("text", F.concat(F.col("name"), F.lit(" raised "), money))


def finance_by_race(rows: DataFrame) -> DataFrame:
    """candidates per race (S8): sorted ids, latest coverage end, finance by candidate."""
    return rows.groupBy("race_id").agg(F.sort_array(F.collect_set("candidate_id")).alias("candidate_ids"), F.max("coverage_end_date").alias("asof"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("candidate_id", F.struct("receipts", "disbursements", "cash_on_hand_end_period"))))).alias("finance"))


def posts(payloads: DataFrame, accounts: DataFrame, politicians: DataFrame) -> DataFrame:
    """payloads (user_id, payload JSON) with accounts (user_id, handle, kind, bioguide): a record a post;
    a member's post links to the member or names the handle as unresolved, others to nobody (S9)."""
    each = payloads.select("user_id", F.inline(F.from_json("payload", POSTS)["data"])).join(accounts, "user_id")
    each = each.join(politicians.select(F.col("bioguide_id").alias("bioguide"), "entity_id"), "bioguide", "left")
    missing = (F.col("kind") == "member") & F.col("entity_id").isNull()
    # Keys of the author that have default values stay out of the payload, so that its hash is stable:
    # to_json leaves out nulls.
    author = F.struct("handle", F.nullif(F.col("kind"), F.lit("member")).alias("kind"), F.nullif(F.col("bioguide"), F.lit("")).alias("bioguide"))
    return each.select(F.to_json(F.struct("id", "text", "created_at", "lang", author.alias("author"))).alias("raw_payload"), F.concat(F.lit("https://x.com/"), "handle", F.lit("/status/"), "id").alias("url"), "text", F.to_timestamp("created_at").alias("event_time"), F.when(F.col("kind") == "member", F.col("entity_id")).alias("entity_id"), F.when(missing, F.concat(F.lit("@"), "handle")).alias("unresolved"))


def rating_feed(payloads: DataFrame, labels: dict[str, str] = FEED_LABELS) -> DataFrame:
    """payloads (payload JSON) as state, rating, asof; unknown labels go."""
    each = payloads.select(F.inline(F.from_json("payload", RATINGS)["ratings"]))
    return each.select(F.upper("district").alias("state"), lookup(labels, F.lower(F.trim("rating"))).alias("rating"), F.to_date("date").alias("asof")).where("rating is not null")


def rating_cards(pages: DataFrame, labels: dict[str, str] = CARD_LABELS) -> DataFrame:
    """pages (html, fetched: date) of rating cards, a header and the states below it, as state, rating, asof
    (S10).  A header's label is the first of the labels that it holds; cards without one go."""
    start = r'<div[^>]*class="(?:[^"]*\s)?race-card(?:\s[^"]*)?"'
    cards = pages.select("fetched", F.explode(F.slice(F.split("html", start), 2, 1_000_000)).alias("card"))
    header = F.lower(F.regexp_replace(F.regexp_extract("card", r'(?s)<(\w+)[^>]*class="[^"]*race-card-header[^"]*"[^>]*>(.*?)</\1>', 2), "<[^>]*>", ""))
    known = F.coalesce(*[F.when(header.contains(k), F.lit(v)) for k, v in labels.items()])
    states = F.regexp_extract_all("card", F.lit(r'<span[^>]*class="[^"]*race-district[^"]*"[^>]*>\s*([^<]*?)\s*</span>'), F.lit(1))
    return cards.select(F.explode(states).alias("state"), known.alias("rating"), F.col("fetched").alias("asof")).where("rating is not null")


def keyed_ratings(ratings: DataFrame, races: DataFrame, cycle: int) -> DataFrame:
    """ratings with race_id of the state that they name in any way, for races that exist."""
    keyed = with_states(ratings, "state").withColumn("race_id", F.concat(F.col("abbrev"), F.lit(f"-SEN-{cycle}")))
    return keyed.join(races.select("race_id"), "race_id", "left_semi").drop("fips", "abbrev", "state_name")


def senators(legislators: DataFrame, social: DataFrame) -> DataFrame:
    """Legislators whose last term is in the Senate (S13): bioguide_id, name, state, class, party, handle,
    fec_ids."""
    last = legislators.withColumn("term", F.element_at("terms", -1)).where("term.type = 'sen'")
    name = F.coalesce("name.official_full", F.concat_ws(" ", "name.first", "name.last"))
    out = last.select(F.col("id.bioguide").alias("bioguide_id"), name.alias("name"), F.col("name.first").alias("first"), F.col("name.last").alias("last"), F.col("name.nickname").alias("nickname"), F.col("term.state").alias("state"), F.col("term.class").alias("class"), lookup({"Democrat": "D", "Republican": "R", "Independent": "I"}, F.col("term.party")).alias("party"), F.col("id.fec").alias("fec_ids"))
    return out.join(social.select("bioguide_id", "handle"), "bioguide_id", "left")


def _names(*names: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull() & (x != "")))


def _spaced(*parts) -> Column:
    return F.when(F.greatest(*[F.col(p).isNull().cast("int") for p in parts]) == 0, F.concat_ws(" ", *parts))


def politician_entities(rows: DataFrame) -> DataFrame:
    """senators as entities with their aliases in order, without repeats."""
    tag = F.concat(F.lit("("), "party", F.lit("-"), "state", F.lit(")"))
    names = _names(F.col("name"), _spaced("first", "last"), _spaced("nickname", "last"), F.col("last"), F.concat_ws(" ", F.col("last"), tag), F.concat_ws(" ", "first", "last", tag), F.concat(F.lit("@"), "handle"))
    aliases = F.array_distinct(F.concat(names, F.coalesce("fec_ids", F.array().cast("array<string>"))))
    return rows.select(F.concat(F.lit("bioguide:"), "bioguide_id").alias("canonical_id"), "name", F.lit("Politician").alias("entity_type"), aliases.alias("aliases"))


def jurisdiction_entities(spark: SparkSession) -> DataFrame:
    """The states as entities."""
    return state_table(spark).select(F.concat(F.lit("fips:"), "fips").alias("canonical_id"), "name", F.lit("Jurisdiction").alias("entity_type"), F.array("abbrev", "name").alias("aliases"))


def indicator_entities(series: DataFrame) -> DataFrame:
    """series (series_id, title, aliases) as entities."""
    aliases = F.array_distinct(F.concat(F.array("series_id", "title"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return series.select(F.concat(F.lit("fred:"), "series_id").alias("canonical_id"), F.col("title").alias("name"), F.lit("EconomicIndicator").alias("entity_type"), aliases.alias("aliases"))


def race_table(races: DataFrame, senators: DataFrame, cycle: int) -> DataFrame:
    """races (state: postal code, class, special, salient) with race_id, fips, state_name and incumbent, the
    first senator (bioguide_id, state, class) of that seat (S14)."""
    sits = senators.groupBy("state", "class").agg(F.min("bioguide_id").alias("incumbent"))
    known = with_states(races, "state").where("fips is not null")
    return known.join(sits, ["state", "class"], "left").withColumn("race_id", F.concat("abbrev", F.lit(f"-SEN-{cycle}"))).withColumn("cycle", F.lit(cycle)).drop("abbrev")


def race_entities(races: DataFrame) -> DataFrame:
    """race_table's rows as entities."""
    name = F.concat("state_name", F.lit(" Senate"), F.when(F.col("special"), " Special").otherwise(""), F.lit(" "), F.col("cycle").cast("string"))
    return races.select(F.concat(F.lit("race:"), "race_id").alias("canonical_id"), name.alias("name"), F.lit("Race").alias("entity_type"), F.array_distinct(F.array("race_id", name, F.concat("state_name", F.lit(" Senate race")))).alias("aliases"))


def polls(spark: SparkSession, path: str) -> DataFrame:
    """Poll averages as landed."""
    return spark.read.schema("race_id string, value decimal(20,6), asof date, source_url string, content_hash string").parquet(path)
