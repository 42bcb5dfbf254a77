"""Registry, extraction, ledger, heads and streams on small frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import cluster, extract, graph, ground, registry, resolve, rows, verify
from tracewell.plans import views
from tracewell.streaming import flips, ingest

T0 = dt.datetime(2026, 9, 10, 12, 30)


def test_states_and_ids(spark):
    said = spark.createDataFrame([(1, " New   York. "), (2, "ga"), (3, "06"), (4, "Narnia"), (5, None)], "k long, place string")
    assert {r.k: r.abbrev for r in registry.with_states(said, "place").collect()} == {1: "NY", 2: "GA", 3: "CA", 4: None, 5: None}
    e = spark.createDataFrame([(1, "fec:H00000001", []), (2, "bioguide:S000001", ["H00000001", "H00000002"]), (3, "bioguide:S000002", ["H00000002"])], "entity_id long, canonical_id string, fec_ids array<string>")
    ids = spark.createDataFrame([("h00000001 ",), ("H00000002",), ("H00000003",), ("x",), (None,)], "raw string")
    assert {r.raw: r.entity_id for r in registry.by_fec_id(ids, "raw", e).collect()} == {"h00000001 ": 1, "H00000002": 2, "H00000003": None, "x": None, None: None}
    members = spark.createDataFrame([(" s000002",), ("S00002",)], "raw string")
    assert {r.raw: r.entity_id for r in registry.by_canonical_id(members, "raw", "bioguide", e).collect()} == {" s000002": 3, "S00002": None}


def test_bills_are_minted_once(spark):
    docs = spark.createDataFrame([(1, "vote", 119, None, None, "S877", None, "v"), (2, "bill", 119, "S", "877", None, "Fish Act", "b"), (3, "bill", 119, "S", "877", None, "Other", "c"), (4, "vote", 119, None, None, "PN4", None, "p"), (5, "post", None, None, None, None, None, "x")], "doc_id long, kind string, congress int, type string, number string, bill_number string, title string, url string")
    named = registry.bill_of(docs)
    none = spark.createDataFrame([], "canonical_id string, name string")
    first = registry.minted_bills(named.where("doc_id = 1"), none)
    assert [(r.canonical_id, r.name, r.aliases, r.change) for r in first.collect()] == [("bill:119-s-877", "S. 877 (119th)", ["S. 877 (119th)", "S. 877"], "insert")]
    known = registry.current_names(none, first)
    second = registry.minted_bills(named, known)
    assert [(r.name, r.change) for r in second.collect()] == [("S. 877 (119th): Fish Act", "update")]
    assert registry.minted_bills(named, registry.current_names(known, second)).isEmpty()


def test_fuzzy_candidates_equal_brute_force(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(3, 6)))
    names = [(i, f"{word()} {word()}") for i in range(40)]
    said = [(i, f"{word()} {rng.choice(names)[1].split()[0]}") for i in range(15)]
    index = resolve.alias_index(spark.createDataFrame([(i, n, None) for i, n in names], "entity_id long, name string, aliases array<string>"))
    got = {}
    for r in resolve.fuzzy_candidates(spark.createDataFrame(said, "mention_id long, mention string"), index, f"file://{tmp_path}").collect():
        got.setdefault(r.mention_id, []).append((-r.score, r.entity_id))

    def ratio(a, b):
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return round(200 * resolve._common(a, b) / (len(a) + len(b)), 4)

    for i, m in said:
        assert sorted(got[i]) == sorted((-ratio(m, n), e) for e, n in names)[:5]


def test_fuzzy_resolve_equals_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(3, 9)))
    names = [(i, " ".join(word() for _ in range(rng.randint(1, 3)))) for i in range(60)]

    def typo(t):
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], [rng.choice("abcdef ")], [t[at], rng.choice("abcdef")]])
            t = t or ["a"]
        return " ".join("".join(t).split()) or "a"

    said = [(i, typo(rng.choice(names)[1])) for i in range(120)]
    index = resolve.alias_index(spark.createDataFrame([(i, n, None) for i, n in names], "entity_id long, name string, aliases array<string>"))
    got = {r.mention_id: r.entity_id for r in resolve.fuzzy_resolve(spark.createDataFrame(said, "mention_id long, mention string"), index).collect()}
    order = lambda t: " ".join(sorted(t.split()))
    found = 0
    for i, m in said:
        near = sorted(((-200 * resolve._common(order(m), order(n)) / (len(m) + len(n)), e) for e, n in names))
        second = near[1][0] if len(near) > 1 else 0
        want = near[0][1] if -near[0][0] >= 90 and second - near[0][0] >= 8 else None
        assert got[i] == want
        found += want is not None
    assert found > 20


def test_gate_and_cores(spark):
    docs = spark.createDataFrame([(1, "fec", "u"), (2, "news", "u"), (3, "news", "u"), (4, "news", "u")], "doc_id long, source string, url string")
    told = spark.createDataFrame([(1, False, 0.1, "x"), (2, True, 0.3, None), (3, False, 0.5, "dull"), (4, False, 0.9, "dull")], "doc_id long, relevant boolean, confidence double, reason string")
    got = {r.doc_id: (r.relevant, r.confidence, r.dropped_reason, r.review) for r in extract.gate(docs, told).collect()}
    assert got == {1: (True, 1.0, None, False), 2: (True, 0.3, None, False), 3: (False, 0.5, "dull", True), 4: (False, 0.9, "dull", False)}
    texts = spark.createDataFrame([(1, "He said “No deal” today", T0), (2, "x y z", None)], "doc_id long, text string, event_time timestamp")
    out = spark.createDataFrame([(1, 'said "No  deal"', None, "Georgia"), (2, "not there", T0, " federal ")], "doc_id long, span string, event_time timestamp, jurisdiction string")
    cores = {r.doc_id: (r.error, r.event_time, r.jurisdiction) for r in extract.event_cores(out, texts).collect()}
    assert cores == {1: (None, T0, "fips:13"), 2: ("ungrounded", T0, "federal")}


def test_ledger_and_reviews(spark):
    form = "item_id long, attempt int, status string"
    ledger = spark.createDataFrame([(1, 0, "EXTRACTED"), (2, 0, "FAILED")], form)
    tried = spark.createDataFrame([(1, 1, "FAILED"), (2, 1, "FAILED"), (2, 2, "DROPPED"), (3, 1, "FAILED")], form)
    once = extract.run_ledger(ledger, tried)
    assert sorted(map(tuple, once.collect())) == [(1, 0, "EXTRACTED"), (2, 2, "DROPPED"), (3, 1, "FAILED")]
    assert sorted(map(tuple, extract.run_ledger(once, tried).collect())) == sorted(map(tuple, once.collect()))
    r = spark.createDataFrame([(1, "k", "m", "f", 1), (1, "k", "m", "f", 2), (1, "k", "n", "f", 3)], "doc_id long, kind string, mention string, field string, pos int")
    new = extract.review_inserts(r.limit(0), r, F.col("pos"))
    assert sorted(x.pos for x in new.collect()) == [1, 3] and extract.review_inserts(new, r, F.col("pos")).isEmpty()
    assert extract.open_reviews(r.withColumn("resolved", F.col("pos") > 1), new).first().n == 3


def test_rebuild_is_idempotent(spark):
    stored = spark.createDataFrame([(1, "a"), (1, "gone"), (2, "b")], "head long, v string")
    fresh = spark.createDataFrame([(1, "a"), (1, "new"), (3, "not asked")], "head long, v string")
    heads = spark.createDataFrame([(1,)], "head long")
    once = rows.rebuilt(stored, fresh, "head", heads)
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (1, "new"), (2, "b")]
    assert sorted(map(tuple, rows.rebuilt(once, fresh, "head", heads).collect())) == sorted(map(tuple, once.collect()))


def test_tiebreak(spark):
    c = spark.createDataFrame([(i, 9, d) for i, d in enumerate(["NEW", "ATTACH", "TIEBREAK", "TIEBREAK", "TIEBREAK", "TIEBREAK"])], "id long, cluster long, decision string")
    v = spark.createDataFrame([(2, 9, True, 0.6), (3, 9, False, 0.9), (4, 9, True, 0.59)], "id long, cluster long, same boolean, confidence double")
    assert {r.id: (r.attach, r.review) for r in cluster.settled(c, v).collect()} == {0: (False, False), 1: (True, False), 2: (True, False), 3: (False, False), 4: (False, True), 5: (False, False)}


def test_blocks_of_neighbours_equal_all_pairs(spark):
    """Blocks far smaller than a stretch, one vector that many rows share, ties by id."""
    rng = random.Random(7)
    data = [(i, T0 + dt.timedelta(hours=rng.randint(0, 200)), [1.0, 2.0, 3.0] if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(data, "id long, ts timestamp, embedding array<double>")
    got = {(r.id, r.rank): (r.neighbour, r.sim) for r in cluster.window_neighbours(df, df, k=4, digits=6, block=7).collect()}
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for i, t, v in data:
        near = sorted((-round(sum(a * b for a, b in zip(unit(v), unit(w))), 6), j) for j, u, w in data if j != i and abs((t - u).total_seconds()) <= 48 * 3600)[:4]
        assert [got[i, n + 1][0] for n in range(len(near))] == [j for _, j in near]


def test_flip_details_and_reviews(spark):
    form = "head long, ts timestamp, entity long, topic string, role string, stance string, confidence double, span string"
    s = spark.createDataFrame([(1, T0, 9, "tax", "actor", "support", 0.9, "for"), (2, T0 + dt.timedelta(days=5), 9, "tax", "actor", "oppose", 0.9, "against")], form)
    members = spark.createDataFrame([(1, 11), (1, 12), (2, 21)], "head long, id long")
    said = spark.createDataFrame([(11, 9, "tax", "actor", "for"), (12, 9, "tax", "actor", "other"), (21, 9, "tax", "actor", "against")], "id long, entity long, topic string, role string, span string")
    sources = spark.createDataFrame([(11, 1, "T3", "a"), (11, 2, "T1", "b"), (12, 3, "T1", "c")], "id long, source_id long, tier string, url string")
    sourced = verify.stance_sources(s, members, said, sources)
    assert {r["head"]: r.url for r in sourced.collect()} == {1: "b", 2: None}
    flips = verify.flip_details(verify.stance_flips(s), sourced)
    told = {r["head"]: r.flip_of and tuple(r.flip_of) for r in flips.collect()}
    assert told == {1: None, 2: (1, T0, "support", "for", "b")}
    assert [(r["head"], r.url) for r in views.stance_timeline(s, members, said, sources, flips).collect()] == [(1, "b")]
    verdicts = spark.createDataFrame([(1, True, 0.4), (2, False, 0.9)], "head long, mismatched boolean, confidence double")
    got = {(r["head"], r.field) for r in verify.review_rows(verdicts, flips, spark.createDataFrame([(1,), (2,)], "head long")).collect()}
    assert got == {(2, "verify:stance_flip"), (1, "verify:numeric"), (2, "verify:numeric"), (1, "verify:confidence")}


def test_prose_and_answers(spark):
    prose = spark.createDataFrame([(1, "CPI rose 0.4", [1]), (2, "x", []), (3, "Rick Scott saw 7", [2])], "head long, text string, cited array<int>")
    spans = spark.createDataFrame([(1, 1, "up 0.4 percent"), (3, 1, "nothing")], "head long, n int, span string")
    named = spark.createDataFrame([(1, 5, "CPI"), (3, 6, "Rick Scott")], "head long, entity_id long, surface string")
    cast = spark.createDataFrame([(1, 5)], "head long, entity_id long")
    got = {r["head"]: r.problems for r in ground.prose_problems(prose, spans, named, cast).collect()}
    assert got == {1: [], 2: ["no citations"], 3: ["citation 2", "entity Rick Scott", "number 7"]}
    hits = ground.lexicon_hits(spark.createDataFrame([(1, "what did rick scott say"), (2, "prick scotty")], "doc_id long, text string"), spark.createDataFrame([("Rick Scott", 6)], "surface string, entity_id long"), any_case=True)
    assert [(r.doc_id, r.entity_id) for r in hits.collect()] == [(1, 6)]


def test_scorer_of_imperfect_passes(spark):
    gold = spark.createDataFrame([(1, True, "statement"), (2, False, None), (3, True, "nomination")], "item long, relevant boolean, event_type string")
    guess = spark.createDataFrame([(1, True, False, "statement"), (2, True, False, "statement"), (3, False, True, None)], "item long, relevant boolean, failed boolean, event_type string")
    pairs = lambda name, x: spark.createDataFrame(x, f"item long, {name} string")
    told = lambda x: spark.createDataFrame(x, "item long, entity string, topic string, position string")
    m = graph.pass_scores(gold, guess, {"entities": pairs("entity", [(1, "a"), (3, "b")]), "topics": pairs("topic", [(1, "t")]), "stances": told([(1, "a", "t", "support")])}, {"entities": pairs("entity", [(1, "a"), (1, "x"), (2, "y")]), "topics": pairs("topic", [(1, "t")]), "stances": told([(1, "a", "t", "strongly_support")])})
    got = {r.metric: r.value for r in m.collect()}
    assert len(got) == 17 and got["items"] == 3 and got["failed"] == 1
    assert got["gate.accuracy"] == pytest.approx(1 / 3) and got["gate.drop_recall"] == 0 and got["event_type.accuracy"] == 1
    assert (got["entities.precision"], got["entities.recall"]) == (0.5, 0.5) and got["topics.f1"] == 1
    assert got["stance.position_accuracy"] == 0 and got["stance.direction_accuracy"] == 1


def test_flips_by_state(spark, tmp_path):
    """Stances of several roles, days and batches, out of order and again, against all at once; batches write what
    changed alone."""
    rng, base = random.Random(4), f"file://{tmp_path}"
    hours = (0, 1, 1, 30, 200, 700)
    data = [(i, T0 + dt.timedelta(hours=rng.choice(hours)), 1 if rng.random() < 0.8 else 2, 1, rng.choice(["actor", "speaker"]), rng.choice(["support", "oppose", "neutral_unclear"]), rng.choice([0.2, 0.9])) for i in range(60)]
    data += [(i, t, e, p, "zzz", s, c) for i, t, e, p, _, s, c in data[:10]]
    rng.shuffle(data)
    key = ["head", "entity", "role", "prior_head", "flip"]
    told = lambda df: sorted(map(str, df.select(key).collect()))
    for part in (data[:30], data[30:66], data[66:], data[:5]):
        spark.createDataFrame(part, ingest.STANCE).coalesce(1).write.mode("append").parquet(f"{base}/in")
        flips.flip_changes(spark, f"{base}/in", f"{base}/flips", f"{base}/state")
    assert told(flips.latest_flips(spark, f"{base}/flips")) == told(verify.stance_flips(spark.createDataFrame(data, ingest.STANCE)))
    sizes = {r.batch: r["count"] for r in spark.read.parquet(f"{base}/flips").groupBy("batch").count().collect()}
    assert sizes[0] == 30 and 4 <= sizes[2] < 20 and 3 not in sizes


def test_flips_of_many_keys(spark, tmp_path):
    """30,000 entities and topics take no call each; a confidence may be missing, and a batch may hold nothing."""
    import time

    base = f"file://{tmp_path}"
    e = spark.range(60_000).select(F.col("id").alias("head"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7).alias("ts"), (F.col("id") % 30_000).alias("entity"), F.lit(1).alias("topic"), F.lit("actor").alias("role"), F.when(F.col("id") < 30_000, "support").otherwise("oppose").alias("stance"), F.when(F.col("id") % 3 > 0, 0.9).alias("confidence"))
    began = time.time()
    for part in ("head >= 30000", "head < 30000", "head < 0"):
        e.where(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        flips.flip_changes(spark, f"{base}/in", f"{base}/flips", f"{base}/state")
    took = time.time() - began
    told = lambda df: sorted(map(str, df.select("head", "confidence", "prior_head", "flip").collect()))
    assert told(flips.latest_flips(spark, f"{base}/flips")) == told(verify.stance_flips(e))
    assert took < 60


def test_late_stances_change_flips(spark, tmp_path):
    base = f"file://{tmp_path}"
    form = ingest.STANCE
    day = lambda n: T0 + dt.timedelta(days=n)
    for part in ([(1, day(0), 9, 1, "actor", "support", 0.9), (3, day(2), 9, 1, "actor", "oppose", 0.9)], [(2, day(1), 9, 1, "actor", "neutral_unclear", 0.9)]):
        spark.createDataFrame(part, form).write.mode("append").parquet(f"{base}/in")
        ingest.flips_as_they_come(spark, f"{base}/in", f"{base}/store", f"{base}/flips", f"{base}/state")
        got = {r["head"]: (r.prior_head, r.flip) for r in spark.read.schema(ingest.FLIP).parquet(f"{base}/flips").collect()}
        assert got == ({1: (None, False), 3: (1, True)} if len(part) == 2 else {1: (None, False), 2: (1, False), 3: (2, False)})
