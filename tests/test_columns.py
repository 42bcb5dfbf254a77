"""Ids, mentions, spans, numbers, scores (fixture cases)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracewell.functions import columns as c


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize("namespace, raw, ok", [("bioguide", "S000033", True), ("bioguide", "s000033", False), ("fec", "C00000001", True), ("fec", "H8AB12345", True), ("fips", "13", True), ("fips", "133", False), ("race", "GA-SEN-2026", True), ("bill", "119-hr-9340", True), ("bill", "119-x-1", False), ("fred", "CPIAUCSL", True), ("fred", "cpi", False)])
def test_ids(spark, namespace, raw, ok):
    assert one(spark, c.make_id(namespace, F.col("raw")), raw=raw) == (f"{namespace}:{raw}" if ok else None)
    back = one(spark, c.split_id(F.concat(F.lit(namespace + ":"), F.col("raw"))), raw=raw)
    assert (tuple(back) if back else None) == ((namespace, raw) if ok else None)


def test_split_unknown_namespace(spark):
    assert one(spark, c.split_id(F.col("x")), x="nope:13") is None
    assert one(spark, c.split_id(F.col("x")), x="fips") is None


def test_bills(spark):
    assert one(spark, c.vote_bill_id(F.lit(119), F.col("n")), n="SJRES12") == "bill:119-sjres-12"
    assert one(spark, c.vote_bill_id(F.lit(119), F.col("n")), n="PN1129") is None
    assert one(spark, c.bill_label(F.col("n")), n="bill:119-hr-9340") == "H.R. 9340 (119th)"
    assert one(spark, c.bill_label(F.col("n")), n="bill:119-sres-7") == "SRES 7 (119th)"


@pytest.mark.parametrize("mention, forms", [("Sen. Rick Scott (R-FL)", ["rick scott r fl", "rick scott"]), ("@handle", ["handle"]), ("Ben Ray Luján", ["ben ray lujan"]), ("Angus King Jr.", ["angus king"]), ("", []), ("O'Brien", ["obrien"]), ("(x)", ["x"])])
def test_mention_forms(spark, mention, forms):
    assert one(spark, c.mention_forms(F.col("m")), m=mention) == forms


@pytest.mark.parametrize("span, ok", [("“prices  rose”", True), ('"prices rose"', True), ("pr", False), ("prices fell", False), (None, False), ("—then", True)])
def test_grounding(spark, span, ok):
    assert one(spark, c.grounded(F.col("span"), F.lit('He said\n"prices rose" -then left.')), span=span) is ok


def test_numbers(spark):
    assert sorted(one(spark, c.number_set(F.col("t")), t="1,200 jobs, 3.5% and 1200 again")) == ["1200", "3.5"]


@pytest.mark.parametrize("sim, out", [(None, "NEW"), (0.0, "NEW"), (0.6999, "NEW"), (0.70, "TIEBREAK"), (0.8499, "TIEBREAK"), (0.85, "ATTACH"), (1.0, "ATTACH")])
def test_bands(spark, sim, out):
    assert one(spark, c.band(F.lit(sim).cast("double"))) == out


@pytest.mark.parametrize("kind, url, key", [("news", "https://www.a.com/x", "news|a.com"), ("news", "https://a.com/y", "news|a.com"), ("social_post", "https://x.com/Ann/status/1", "social_post|x.com/ann"), (None, "https://a.com", "unknown|a.com")])
def test_independence_key(spark, kind, url, key):
    assert one(spark, c.independence_key(F.col("kind"), F.col("url")), kind=kind, url=url) == key


def test_election_and_recency(spark):
    assert one(spark, c.election_day(F.lit(2026))) == dt.date(2026, 11, 3)
    assert one(spark, c.election_day(F.lit(2028))) == dt.date(2028, 11, 7)
    now = F.lit("2026-09-10 00:00:00").cast("timestamp")
    assert one(spark, c.recency(F.lit("2026-09-08 00:00:00").cast("timestamp"), now)) == pytest.approx(0.5)
    assert one(spark, c.recency(F.lit("2026-09-12 00:00:00").cast("timestamp"), now)) == 1.0
    assert one(spark, c.election_proximity(F.lit(0.5), F.lit(2026), now)) == pytest.approx(0.5 * math.exp(-54 / 60))
    assert one(spark, c.election_proximity(F.lit(0.5), F.lit(2024), now)) == 0.0


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.6, 0.8], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>").select(c.cosine(F.col("a"), F.col("b")).alias("s"), c.cosine(F.col("a"), F.col("z")).alias("z")).first()
    assert row.s == pytest.approx(0.6, abs=1e-6) and row.z == 0.0
