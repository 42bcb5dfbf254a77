"""Operators on small frames: resolution, claims, clustering, verification, graph, upserts, streams."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.functions import claims
from tracewell.operators import cluster, graph, ground, resolve, rows, verify
from tracewell.plans import views
from tracewell.sources import scans
from tracewell.streaming import ingest

T0 = dt.datetime(2026, 9, 10, 12, 30)


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_resolution(spark):
    index = resolve.alias_index(spark.createDataFrame([(1, "Rick Scott", ["Scott", "@SenRickScott"]), (2, "Tim Scott", ["Scott"]), (3, "Jon Ossoff", ["Ossoff"]), (4, "Series 9", ["cpi 9"])], "entity_id long, name string, aliases array<string>"))
    m = spark.createDataFrame([(1, "Sen. Rick Scott (R-FL)"), (2, "Scott"), (3, "@SenRickScott"), (4, "nobody"), (5, ""), (6, "Jon Osoff")], "mention_id long, mention string")
    got = {r.mention_id: (r.entity_id, r.method, r.owners) for r in resolve.exact_resolve(m, index).collect()}
    assert got == {1: (1, "exact", 1), 2: (None, "none", 2), 3: (1, "exact", 1), 4: (None, "none", 0), 5: (None, "none", 0), 6: (None, "none", 0)}
    fuzzy = {r.mention_id: (r.entity_id, r.confidence) for r in resolve.fuzzy_resolve(m.where("mention_id in (4, 6)"), index).collect()}
    assert fuzzy[4] == (None, None) and fuzzy[6][0] == 3 and fuzzy[6][1] == pytest.approx(18 / 19, abs=1e-4)
    assert [r.form for r in resolve.ambiguous_aliases(index).collect()] == ["scott"]


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randint(0, 9))) for _ in range(2))
        assert resolve._common(a, b) == plain(a, b)


def test_topics(spark):
    topics = spark.createDataFrame([("trade_tariffs",), ("labor_jobs",), ("housing",), ("trade_deals",)], "topic string")
    words = spark.createDataFrame([("tariffs",), ("trade",), ("hous",), ("job",), ("labor_jobs",)], "word string")
    got = {r.word: r.topics for r in resolve.topic_matches(words, topics).collect()}
    assert got == {"tariffs": "trade_tariffs", "trade": "trade_deals,trade_tariffs", "hous": "housing", "labor_jobs": "labor_jobs"}


@pytest.mark.parametrize("span, want", [
    ("Core CPI rose 0.4% in August", ("CPILFESL", 0.4, False, dt.date(2026, 8, 1))),
    ("CPI fell by 1.2 percent from a year ago", ("CPIAUCSL", -1.2, True, dt.date(2026, 8, 1))),
    ("employers added 175,000 jobs in December 2025", ("PAYEMS", 175.0, False, dt.date(2025, 12, 1))),
    ("the economy lost 1.2 million jobs", ("PAYEMS", -1200.0, False, dt.date(2026, 8, 1))),
    ("unemployment was at 4.1% in November", ("UNRATE", 4.1, False, dt.date(2025, 11, 1))),
    ("CPI was discussed", None), ("prices rose 3%", None), ("jobs were created", None),
])
def test_claims(spark, span, want):
    aliases = spark.createDataFrame([("CPIAUCSL", "CPI"), ("CPILFESL", "core CPI"), ("UNRATE", "unemployment"), ("PAYEMS", "payrolls"), ("OTHER", "prices")], "series_id string, alias string")
    got = claims.parse_claims(spark.createDataFrame([(1, span, T0)], "span_id long, span string, event_time timestamp"), aliases).collect()
    assert [(r.series_id, pytest.approx(r.claimed), r.yoy, r.period) for r in got] == ([want] if want else [])


def test_claim_outcomes(spark):
    ind = spark.sql("select 'CPIAUCSL' series_id, date'2026-07-01' asof, s source, cast(320.0 as decimal(20,6)) value from values ('fred'),('bls') t(s) union all select 'CPIAUCSL', date'2026-08-01', s, cast(321.28 as decimal(20,6)) from values ('fred'),('bls') t(s)")
    c = spark.createDataFrame([(1, "CPIAUCSL", "pct_change", 0.4, False, dt.date(2026, 8, 1)), (2, "CPIAUCSL", "pct_change", 0.9, False, dt.date(2026, 8, 1)), (3, "CPIAUCSL", "pct_change", 0.4, True, dt.date(2026, 8, 1))], "span_id long, series_id string, kind string, claimed double, yoy boolean, period date")
    assert {r.span_id: r.outcome for r in claims.claim_outcomes(c, ind).collect()} == {1: "match", 2: "mismatch", 3: "no_reference"}


def vec(s, axis, dim=6):
    v = [0.0] * dim
    v[0], v[axis] = s, math.sqrt(1 - s * s)
    return v


def test_rollup(spark):
    m = spark.createDataFrame([(1, 1, T0, "economic_release", None, ["inflation"], "T1", 0.95), (1, 2, T0 + dt.timedelta(hours=1), "economic_release", "federal", ["labor"], "T3", 0.85), (1, 3, T0 + dt.timedelta(hours=3), "statement", "federal", ["inflation"], "T4", 0.80)], "head long, id long, ts timestamp, event_type string, jurisdiction string, topics array<string>, tier string, confidence double")
    r = cluster.head_scalars(m).first()
    assert (round(r.confidence, 2), r.event_type, r.jurisdiction, r.topics, r.tier, r.event_time) == (0.89, "economic_release", "federal", ["inflation", "labor"], "T1", T0)
    s = verify.corroborate(spark.createDataFrame([(1, "a", "T1"), (1, "b", "T3"), (1, "c", "T4"), (1, "a", "T4")], "head long, key string, tier string")).first()
    assert (s.independent_sources, s.score, s.status) == (3, 2.0, "corroborated")


def sequential(rows_, low, high, hours, k):
    """The greedy rule over one ordered list, without any split into components."""
    placed, out = [], {}
    for ts, i, v, own in sorted(rows_, key=lambda r: (r[0], r[1])):
        near = sorted(((-sum(a * b for a, b in zip(v, w)) / (math.hypot(*v) * math.hypot(*w)), j) for t, j, w, _ in placed if (ts - t).total_seconds() <= hours * 3600))[:k]
        best = {}
        for s, j in near:
            best[out[j]] = max(best.get(out[j], -2), -s)
        held = lambda h: set().union(*(o for _, j, _, o in placed if out[j] == h))
        choice = sorted((-s, h) for h, s in best.items() if own & held(h))
        out[i] = choice[0][1] if choice and -choice[0][0] >= high else i
        placed.append((ts, i, v, own))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_equal_sequential(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(T0 + dt.timedelta(hours=rng.randint(0, 150)), i, [rng.gauss(0, 1) for _ in range(3)], {rng.randint(0, 2)}) for i in range(60)]
    df = spark.createDataFrame([(i, t, v, sorted(o)) for t, i, v, o in data], "id long, ts timestamp, embedding array<double>, entities array<int>")
    got = {r.id: r["head"] for r in cluster.leader_clusters(df, f"file://{tmp_path}", k=5).collect()}
    assert got == sequential(data, 0.7, 0.85, 48, 5)


@pytest.mark.parametrize("block", [7, 4096])
def test_candidates_equal_scoring_all(spark, tmp_path, block):
    """The five best of all entities, whatever letters they start with, with ties, long names and entities of several
    aliases."""
    rng = random.Random(9)
    words = ["catherine", "smith", "jo", "ann", "lee", "katherine", "smythe", "o", "brien", "garcia", "x" * 70]
    names = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)]
    entities = spark.createDataFrame([(i, n, [names[-1 - i]] if i % 3 == 0 else None) for i, n in enumerate(names)], "entity_id long, name string, aliases array<string>")
    mentions = ["Jatherine Xmith", "qqq", "lee ann jo", "Smith", "x" * 66 + " leo", *names[:5]]
    index = resolve.alias_index(entities)
    forms = {}
    for r in index.where("not digit").collect():
        forms.setdefault(r.entity_id, set()).add(" ".join(sorted(r.form.split())))

    def score(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(new[j], row[j + 1]))
            row = new
        return round(200.0 * row[-1] / (len(a) + len(b)), 4)

    rows_ = spark.createDataFrame(list(enumerate(mentions)), "mention_id long, mention string")
    got = sorted((r.mention_id, -r.score, r.entity_id) for r in resolve.fuzzy_candidates(rows_, index, f"file://{tmp_path}", block=block).collect())
    want = []
    for i, m in enumerate(mentions):
        a = " ".join(sorted(m.lower().split()))
        want += [(i, *x) for x in sorted((-max(score(a, b) for b in bs), e) for e, bs in forms.items())[:5]]
    assert got == want


def odd_events(seed, n=60):
    rng = random.Random(seed)
    return [(T0 + dt.timedelta(hours=rng.randint(0, 150)), i, [rng.gauss(0, 1) for _ in range(3)], {rng.randint(0, 2), rng.randint(0, 2)}) for i in range(n)]


def event_frame(spark, data):
    return spark.createDataFrame([(i, t, v, sorted(o)) for t, i, v, o in data], "id long, ts timestamp, embedding array<double>, entities array<long>")


def test_pruned_neighbours(spark, tmp_path):
    """Clustered vectors: the same neighbours as without pivots, and most pairs of cells are never multiplied."""
    rng = random.Random(6)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    data = [(i, T0 + dt.timedelta(hours=rng.randint(0, 90)), [m + rng.gauss(0, 0.03) for m in middles[i % 12]]) for i in range(600)] + [(600, T0, None), (601, None, [1.0] * 6)]
    rows_ = spark.createDataFrame(data, "id long, ts timestamp, embedding array<double>")
    got, told = cluster.pruned_neighbours(rows_, rows_, f"file://{tmp_path}", k=5, digits=6, block=20)
    want = cluster.window_neighbours(rows_, rows_, k=5, digits=6)
    order = lambda df: sorted((r.id, r.rank, r.neighbour, r.sim) for r in df.collect())
    assert order(got) == order(want)
    pairs, done = told.agg(F.sum("pairs"), F.sum("multiplied")).first()
    assert pairs > 300 and done < 0.6 * pairs


def test_best_of_products():
    """The best of a block over several products, as all similarities sorted at once give them: ties by id, the window,
    rows before only."""
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (2600, 3)).astype(float)
    ids, at = np.arange(2600) * 3, rng.integers(0, 1000, 2600)
    left = (ids[::2][::-1], at[::2][::-1], v[::2][::-1])
    for earlier in (False, True):
        row, col, sim = cluster._best(left, (ids, at, v), 300, 5, 6, earlier)
        got = [[] for _ in left[0]]
        for r, c, s in zip(row, col, sim):
            got[r].append((-s, ids[c]))
        for r, (i, t, x) in enumerate(zip(*left)):
            apart = (ids == i) | (np.abs(at - t) > 300)
            if earlier:
                apart |= (at > t) | ((at == t) & (ids > i))
            assert sorted(got[r]) == sorted((-s, j) for s, j, no in zip(v @ x, ids, apart) if not no)[:5]


def handed(spark, monkeypatch, *names):
    """Counts the rows that the named kernels of the module are given."""
    n = spark.sparkContext.accumulator(0)
    for name in names:
        def counting(*args, kernel=getattr(cluster, name)):
            run = kernel(*args)

            def counted(left, right):
                n.add(left.num_rows + right.num_rows)
                return run(left, right)

            return counted

        monkeypatch.setattr(cluster, name, counting)
    return n


def test_rows_sent_to_neighbours(spark, tmp_path, monkeypatch):
    """Where pivots prune nothing a row is still not sent to each cell, and blocks hold what a task can."""
    rng = random.Random(8)
    data = [(i, T0 + dt.timedelta(seconds=i), [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)]
    rows_ = spark.createDataFrame(data, "id long, ts timestamp, embedding array<double>")
    n = handed(spark, monkeypatch, "_nearest", "_nearest_of_cells")
    order = lambda df: sorted((r.id, r.rank, r.neighbour, r.sim) for r in df.collect())
    want = order(cluster.window_neighbours(rows_, rows_, k=5, digits=6))
    assert n.value == 6000
    assert order(cluster.pruned_neighbours(rows_, rows_, f"file://{tmp_path}", k=5, digits=6, block=20)[0]) == want
    assert n.value < 6000 + 4 * 6000
    # Groups of cells in parts: the same.
    assert order(cluster.pruned_neighbours(rows_, rows_, f"file://{tmp_path}", k=5, digits=6, block=20, dealt=500)[0]) == want


def test_rounds_read_neighbours_once(spark, tmp_path):
    """However many rounds there are, what gives neighbours and verdicts is computed once."""
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    events = event_frame(spark, [(T0 + dt.timedelta(hours=i), i, [1.0], {1}) for i in range(8)])
    near = spark.createDataFrame([(i, i - 1, 0.9) for i in range(1, 8)], "id long, neighbour long, sim double").mapInArrow(counted, "id long, neighbour long, sim double")
    told = near.select("id", F.col("neighbour").alias("cluster"), F.lit(True).alias("same"), F.lit(0.9).alias("confidence"))
    got = cluster.placed_in_rounds(events, near, f"file://{tmp_path}", 0.5, 0.95, verdicts=told)
    assert {r.id: r["head"] for r in got.collect()} == {i: i - i % 2 for i in range(8)} and n.value == 14


@pytest.mark.parametrize("low, high", [(0.7, 0.85), (-1.0, 0.2)])
def test_rounds_equal_sequential(spark, tmp_path, low, high):
    """With the second bands one component holds all rows, and no group is read whole."""
    data = odd_events(5)
    got = {r.id: r["head"] for r in cluster.leader_clusters(event_frame(spark, data), f"file://{tmp_path}", low, high, k=5, group=0).collect()}
    assert got == sequential(data, low, high, 48, 5) and 1 < len(set(got.values())) < len(data)


def placed_one_by_one(batches, low, high, hours, k, least, verdicts):
    """The rule over batches in order: what is stored never moves, and is near on either side in time."""
    placed, out, reviews = [], {}, set()
    for batch in batches:
        for ts, i, v, own in sorted(batch, key=lambda r: (r[0], r[1])):
            near = sorted(((-sum(a * b for a, b in zip(v, w)) / (math.hypot(*v) * math.hypot(*w)), j) for t, j, w, _ in placed if abs((ts - t).total_seconds()) <= hours * 3600))[:k]
            best = {}
            for s, j in near:
                best[out[j]] = max(best.get(out[j], -2), -s)
            held = lambda h: set().union(*(o for _, j, _, o in placed if out[j] == h))
            choice = sorted((-s, h) for h, s in best.items() if len(own & held(h)) >= least and s >= low)
            out[i] = i
            if choice:
                s, h = -choice[0][0], choice[0][1]
                same, sure = verdicts.get((i, h), (False, None))
                reviews |= {i} if s < high and sure is not None and sure < 0.6 else set()
                out[i] = h if s >= high or same and sure >= 0.6 else i
            placed.append((ts, i, v, own))
    return out, reviews


@pytest.mark.parametrize("seed, least", [(1, 1), (2, 2)])
def test_placements_among_stored(spark, tmp_path, seed, least):
    """Batches out of the order of time, with verdicts of either kind."""
    data = odd_events(seed)
    batches = [data[:25], data[25:40], data[40:]]
    verdicts = {(i, j): ((i + j) % 2 == 0, (i * 7 + j) % 10 / 10) for i in range(60) for j in range(60) if (i + j) % 5 < 3}
    told = spark.createDataFrame([(i, j, s, c, "why") for (i, j), (s, c) in verdicts.items()], "id long, cluster long, same boolean, confidence double, reason string")
    rows, heads, reviews = [], {}, set()
    for batch in batches:
        new = event_frame(spark, batch)
        stored = spark.createDataFrame([(i, t, v, heads[i]) for t, i, v, _ in rows], "id long, ts timestamp, embedding array<double>, head long")
        members = spark.createDataFrame([(heads[i], e) for _, i, _, o in rows for e in o], "head long, entity long")
        placed = cluster.placements(new, stored, members, f"file://{tmp_path}", 0.3, 0.9, k=5, least=least, verdicts=told).persist()
        heads |= {r.id: r["head"] for r in placed.collect()}
        events = new.select("id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("headline"), F.col("id").alias("doc_id"))
        reviews |= {r.doc_id for r in cluster.placement_reviews(placed, events, told).collect()}
        rows += batch
    assert (heads, reviews) == placed_one_by_one(batches, 0.3, 0.9, 48, 5, least, verdicts)
    assert reviews and 1 < len(set(heads.values())) < 60


def test_related(spark):
    heads = spark.createDataFrame([(1, T0, "economic_release", vec(1.0, 1)), (2, T0 - dt.timedelta(days=28), "economic_release", vec(0.9, 2)), (3, T0 + dt.timedelta(days=3), "statement", vec(0.8, 3)), (4, T0 + dt.timedelta(days=1), "nomination", vec(0.0, 4)), (5, T0 - dt.timedelta(days=40), "economic_release", vec(1.0, 1))], "head long, ts timestamp, event_type string, centroid array<double>")
    e = spark.createDataFrame([(h, 7) for h in (1, 2, 3, 4, 5)], "head long, entity long")
    assert {(r.src, r.dst, r.relation) for r in cluster.related_heads(heads, e).collect()} == {(1, 2, "FOLLOWS"), (3, 1, "RESPONDS_TO"), (2, 5, "FOLLOWS")}


def test_stance_flip_prior_blocks(spark):
    s = spark.createDataFrame([(1, T0, 9, "tax", "actor", "support", 0.9), (2, T0 + dt.timedelta(days=1), 9, "tax", "actor", "neutral_unclear", 0.9), (3, T0 + dt.timedelta(days=2), 9, "tax", "actor", "oppose", 0.9), (4, T0 + dt.timedelta(days=3), 9, "tax", "actor", "support", 0.9), (4, T0 + dt.timedelta(days=3), 9, "tax", "speaker", "oppose", 0.9)], "head long, ts timestamp, entity long, topic string, role string, stance string, confidence double")
    got = {(r["head"], r.role): (r.prior_head, r.flip) for r in verify.stance_flips(s).collect()}
    assert got == {(1, "actor"): (None, False), (2, "actor"): (1, False), (3, "actor"): (2, False), (4, "actor"): (3, True), (4, "speaker"): (3, False)}


def test_priors_across_segments(spark):
    """An entity's stances over many days, several a day and on days apart, against a scan in order."""
    rng = random.Random(4)
    data = [(i, T0 + dt.timedelta(hours=rng.choice([0, 1, 1, 30, 200, 700])), 1 if rng.random() < 0.8 else 2, "t", "actor", rng.choice(["support", "oppose", "neutral_unclear"]), rng.choice([0.2, 0.9])) for i in range(60)]
    s = spark.createDataFrame(data, "head long, ts timestamp, entity long, topic string, role string, stance string, confidence double")
    got = {r["head"]: (r.prior_head, r.flip) for r in verify.stance_flips(s).collect()}
    last, want = {}, {}
    for i, _, e, _, _, stance, sure in sorted(data, key=lambda r: (r[1], r[0])):
        before = last.get(e)
        flip = bool(before) and {stance, before[1]} == {"support", "oppose"} and min(sure, before[2]) >= 0.6
        want[i], last[e] = (before and before[0], flip), (i, stance, sure)
    assert got == want and any(f for _, f in want.values())


def test_surfaces_by_their_rarest_word(spark):
    """Surfaces that begin with a frequent word, share words, or have a word that no document has."""
    docs = spark.createDataFrame([(i, f"The Senate met The House, day {i}") for i in range(30)] + [(98, "The Fed and The Federal Reserve"), (99, "the Fed of Ohio."), (100, None)], "doc_id long, text string")
    lexicon = spark.createDataFrame([("The Fed", 1), ("The Federal Reserve", 2), ("Fed", 3), ("The Zzz", 4), ("The Senate", 5), ("Fed", 6)], "surface string, entity_id long")
    got = {(r.doc_id, r.entity_id) for r in ground.lexicon_hits(docs, lexicon).collect()}
    assert got == {(i, 5) for i in range(30)} | {(98, 1), (98, 2), (98, 3), (98, 6), (99, 3), (99, 6)}


def test_verdict(spark):
    heads = spark.createDataFrame([(1, 0.8), (2, 0.8), (3, 0.8)], "head long, base double")
    cor = spark.createDataFrame([(1, "corroborated"), (2, "single_source")], "head long, status string")
    num = spark.createDataFrame([(1, "match", "T1"), (2, "mismatch", "T4")], "head long, outcome string, tier string")
    assert {r["head"]: (r.status, r.confidence) for r in verify.head_verdict(heads, cor, num).collect()} == {1: ("fact_checked", 0.8), 2: ("single_source", 0.4), 3: ("unverified", 0.8)}


def test_edges(spark):
    e = spark.createDataFrame([(1, 1, "a", "AFFECTS", "b", 0.6), (1, 2, "a", "AFFECTS", "b", 0.8)], "head long, id long, src string, relation string, dst string, confidence double")
    assert [(r.id, r.confidence) for r in graph.head_edges(e).collect()] == [(2, 0.8)]


def test_scores(spark):
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "k string")
    r = graph.micro_scores(frame("abc"), frame("bcd"), "k").first()
    assert (r.tp, r.fp, r.fn, r.f1) == (2, 1, 1, pytest.approx(2 / 3))
    r = graph.micro_scores(frame(""), frame(""), "k").first()
    assert (r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0)


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k long, v string")
    assert {(r.k, r.change) for r in rows.changed_rows(old, new, ["k"], ["v"]).collect()} == {(2, "update"), (3, "insert")}
    once = rows.upserted(old, new, ["k"], ["v"])
    same(rows.upserted(once, new, ["k"], ["v"]), once)
    assert rows.changed_rows(once, new, ["k"], ["v"]).isEmpty()


def test_canonical_json(spark):
    a, b = (spark.createDataFrame([(x,)], "j string").select(rows.canonical_json(F.col("j"))).first()[0] for x in ('{"b": 1, "a": {"d": 2, "c": "é"}}', '{"a":{"c":"é","d":2},"b":1}'))
    assert a == b == '{"a":{"c":"é","d":2},"b":1}'


def test_scans(spark):
    obs = spark.createDataFrame([("X", '{"observations":[{"date":"2026-01-01","value":"1.5"},{"date":"2026-02-01","value":"."},{"date":"2026-03-01"}]}')], "series_id string, payload string")
    assert [(str(r.asof), float(r.value)) for r in scans.observations(obs).collect()] == [("2026-01-01", 1.5)]
    rel = '{"status":"REQUEST_SUCCEEDED","Results":{"series":[{"seriesID":"A","data":[{"year":"2026","period":"M02","value":"3"},{"year":"2026","period":"M13","value":"4"},{"year":"2026","period":"M03","value":"-"}]},{"seriesID":"B","data":[{"year":"2026","period":"M01","value":"9"}]}]}}'
    assert [(r.series_id, str(r.asof)) for r in scans.releases(spark.createDataFrame([(rel,)], "payload string"), {"A": "FRED_A"}).collect()] == [("FRED_A", "2026-02-01")]
    with pytest.raises(Exception, match="request failed"):
        scans.releases(spark.createDataFrame([('{"status":"NO"}',)], "payload string"), {"A": "A"}).collect()
    feed = '{"ratings":[{"district":"ga","rating":" Toss-Up","date":"2026-02-01"},{"district":"NC","rating":"Tilt Democrat","date":"2026-02-01"},{"district":"TX","rating":"???","date":"2026-02-01"}]}'
    assert [(r.state, r.rating) for r in scans.rating_feed(spark.createDataFrame([(feed,)], "payload string")).collect()] == [("GA", "tossup"), ("NC", "tossup_d")]
    card = lambda label, *states: f'<div class="race-card x"><h3 class="race-card-header">\n{label} (2)</h3>' + "".join(f'<span class="race-district">{s}</span>' for s in states) + "</div>"
    html = card("Solid Republican", "Ohio", " Iowa ") + card("Odd", "ME") + card("TOSS UP", "GA", "Puerto Rico")
    cards = scans.rating_cards(spark.createDataFrame([(html, dt.date(2026, 1, 1))], "html string, fetched date"))
    assert {(r.state, r.rating) for r in cards.collect()} == {("Ohio", "safe_r"), ("Iowa", "safe_r"), ("GA", "tossup"), ("Puerto Rico", "tossup")}
    races = spark.createDataFrame([("OH-SEN-2026",), ("GA-SEN-2026",)], "race_id string")
    assert {(r.race_id, r.rating) for r in scans.keyed_ratings(cards, races, 2026).collect()} == {("OH-SEN-2026", "safe_r"), ("GA-SEN-2026", "tossup")}
    index = spark.createDataFrame([(8, "2026-01-05"), (12, "2026-02-05"), (1, "2025-01-05")], "rollnumber int, date string")
    assert [r.roll_id for r in scans.roll_call_index(index, "2026-01-01").collect()] == ["RS1190012", "RS1190008"]


def test_claim_problems(spark):
    rec = spark.createDataFrame([(1, "prices rose 0.4% in August"), (2, "wages up 3")], "n long, body string")
    c = spark.createDataFrame([(1, "rose 0.4", [1]), (2, "rose 0.5", [1]), (3, "x", []), (4, "x", [9]), (5, "0.4 and 3", [1, 2])], "claim_id long, text string, cited array<long>")
    assert {r.claim_id: r.problem for r in ground.claim_problems(c, rec).collect()} == {1: None, 2: "numbers", 3: "no citations", 4: "unknown records", 5: None}


def test_ticker_needs_same_day(spark):
    s = spark.createDataFrame([("A", "fred", dt.date(2025, 2, 1), 100.0), ("A", "fred", dt.date(2026, 1, 1), 109.0), ("A", "fred", dt.date(2026, 2, 1), 110.0), ("B", "fred", dt.date(2026, 2, 1), 1.0)], "series_id string, source string, asof date, value double")
    got = views.ticker(s, ("fred", "bls")).collect()
    assert [(r.series_id, r.level, r.change, r.yoy) for r in got] == [("A", 110.0, 1.0, 10.0)]


def test_store_is_compacted(spark, tmp_path):
    """Many batches leave few folders, the same rows, and nothing that comes again; a batch that is tried again after
    a compaction counts once."""
    base, schema = f"file://{tmp_path}", "k long, ts timestamp, x string"
    run = lambda: ingest.ingest_once(spark, f"{base}/in", schema, ["k"], "ts", f"{base}/store", f"{base}/state", buckets=2, most_batches=3)
    for i in range(9):
        spark.createDataFrame([(i, T0, f"new{i}"), (i // 2, T0, "again")], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        run()
        now = ingest._generation(spark, f"{base}/store")
        folders = [n for n in ingest._names(spark, f"{base}/store/generation-{now}") if n.startswith("batch=")]
        assert len(folders) <= 4
    assert now >= 2 and len([n for n in ingest._names(spark, f"{base}/store") if n.startswith("generation-")]) <= 2
    want = [(0, "again")] + [(i, f"new{i}") for i in range(1, 9)]
    told = lambda: sorted((r.k, r.x) for r in ingest.stored(spark, f"{base}/store", schema).collect())
    got = told()
    assert [k for k, _ in got] == [k for k, _ in want] and got[1:] == want[1:]
    # The last batch, as if its commit had been lost.
    last = max(int(f.name) for f in (tmp_path / "state/commits").iterdir() if f.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(tmp_path / "state/commits" / name)
    run()
    assert told() == got


def test_stream_ingest_reads_each_file_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    schema = "k long, ts timestamp"
    df = spark.createDataFrame([(1, T0), (1, T0), (2, T0)], schema)
    df.write.parquet(f"{base}/in")
    for _ in range(2):
        ingest.ingest_once(spark, f"{base}/in", schema, ["k"], "ts", f"{base}/store", f"{base}/state")
    df.write.mode("append").parquet(f"{base}/in")
    ingest.ingest_once(spark, f"{base}/in", schema, ["k"], "ts", f"{base}/store", f"{base}/state")
    assert sorted(r.k for r in ingest.stored(spark, f"{base}/store", schema).collect()) == [1, 2]


def test_owners_in_scope(spark):
    """Types meant, names that nobody owns, nodes without an id, and one name with 20,000 mentions and as many owners."""
    from tracewell.operators import registry

    mentions = spark.range(20_000).select("id", F.lit("a").alias("name"), F.lit("Politician").alias("entity_type")).union(spark.createDataFrame([(-1, "b", "Agency"), (-2, "zz", "Agency"), (-3, None, "Agency")], "id long, name string, entity_type string"))
    nodes = spark.range(20_000).select(F.col("id").alias("node"), F.lit("a").alias("name"), F.when(F.col("id") % 2 == 0, "Candidate").otherwise("Agency").alias("node_type")).union(spark.createDataFrame([(1, "b", "Agency"), (None, "b", "Agency"), (3, None, "Agency")], "node long, name string, node_type string"))
    got = {r.id: r.owners for r in registry.owners_in_scope(mentions, nodes, "id").collect()}
    assert len(got) == 20_003 and {got[i] for i in range(20_000)} == {10_000} and (got[-1], got[-2], got[-3]) == (1, 0, 0)
