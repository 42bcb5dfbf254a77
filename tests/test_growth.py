"""What queries hold or send at once does not grow with their input."""

import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.functions import columns


def test_composition_holds_few_texts(spark):
    texts = ["ﬁn" + "é" * 10_000 + str(i) for i in range(2_000)]
    batch = pa.array([*texts, None, ""], pa.string())
    want = [unicodedata.normalize("NFKC", t) for t in texts[:3]]
    tracemalloc.start()
    held = tracemalloc.get_traced_memory()[0]
    (out,) = columns.composed(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1] - held
    tracemalloc.stop()
    assert len(out) == 2_002 and out[:3].to_pylist() == want and out[2_000:].to_pylist() == [None, ""]
    assert peak < 4_000_000
    assert pa.compute.all(pa.compute.equal(columns.composed(iter([batch.slice(5, 100)])).__next__(), out.slice(5, 100))).as_py()


def test_composition_equals_that_of_all_texts(spark):
    texts = ["plain", "", None, "ﬁne", "étude", "Ⅷ ½", "x y", "\x00tab\t", "日本"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in rows.select("i", columns.compatible(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_vectors_travel_as_they_are(spark):
    """Floats are sent to the blocks as floats, and scaled there to the same doubles."""
    import numpy as np

    from tracewell.operators import cluster

    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=64).astype(np.float32).tolist()) for i in range(40)] + [(40, [0.0] * 64)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")))
    plan = cluster.window_neighbours(rows, rows, k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "zip_with" not in plan
    scaled = rows.select("id", columns.unit(F.col("embedding")).alias("vector")).orderBy("id").toArrow()
    raw = rows.select("id", F.col("embedding").alias("vector")).orderBy("id").toArrow()
    assert np.array_equal(cluster._unit(raw), cluster._matrix(scaled))


def test_word_counts_do_not_depend_on_the_dealing(spark):
    """The whole-word predictor has the same counts whether beginnings are frequent enough to be dealt deeper or not."""
    from tracewell.llm import context_mixing as model

    names = [f"common{i:03d}" for i in range(150)] + [f"coal{i}{c}" for i in range(30) for c in "äb"] + ["x" * 40, "common", "ab", "commo"]
    words = spark.createDataFrame([(w, i % 7) for i, w in enumerate(names)], "word string, n long")

    def counted(block_words):
        out = {}
        for one in model.known_nodes(model.blocks_of(words, block_words)).toPandas().groupby("block"):
            block, edges = model._edges_of(pa.Table.from_pandas(one[1], preserve_index=False))
            word, edge = edges.links
            names = block.column("word").to_pylist()
            for w, e in zip(word.tolist(), edge.tolist()):
                out[names[w], int(edges.at[e])] = edges.nodes[e].tolist()
        return out

    assert counted(20) == counted(1_000_000)


def test_suffix_dedup_cuts_texts_once(spark, monkeypatch):
    """With anchors that are dealt deeper, texts are joined to what is asked of them once, and once more at the end."""
    import numpy as np

    from tracewell.llm import suffix_dedup

    plans = {}

    def stash(df, name, keep=suffix_dedup.stash):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(suffix_dedup, "stash", stash)
    rng = np.random.default_rng(5)
    noise = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    core = noise(150)
    docs = spark.createDataFrame([(i, noise(120) + core + noise(120)) for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.dedup_bytes(docs, shard_pieces=3, texts=False).collect()}
    assert "core-stretches" in plans and got == {i: 0 if i == 0 else got[i] for i in range(20)} and all(got[i] >= 150 for i in range(1, 20))
    assert [n for n in ("pieces", "cores", "core-stretches", "sorted") if "text" in plans.get(n, "")] == ["pieces"]


def held(rows):
    """Whether the plan deals rows into a number of partitions of its own."""
    return "REPARTITION_BY_NUM" in rows._jdf.queryExecution().executedPlan().toString()


def test_golden_audit_deals_by_number_of_rows(spark, monkeypatch):
    from tracewell.operators import graph, rows

    monkeypatch.setattr(graph, "dealt", lambda r, keys: rows.dealt(r, keys, per=3))
    items = spark.createDataFrame([(i,) for i in range(20)] + [(3,), (3,), (None,), (None,)], "item long")
    stances = spark.createDataFrame([(i, i % 3) for i in range(20)] * 2 + [(1, None), (None, 2)], "item long, entity long")
    named = spark.createDataFrame([(i, 1) for i in range(20)] * 3 + [(1, None), (None, 2)], "item long, entity long")
    out = graph.golden_problems(items, stances, named)
    got = sorted(map(tuple, out.collect()), key=str)
    want = [(3, "duplicate id"), (None, "duplicate id"), (1, None), (None, "stance of 2")] + [(i, f"stance of {i % 3}") for i in range(20) if i % 3 != 1]
    assert got == sorted(want, key=str)
    assert held(out) and "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_head_spans_are_dealt_by_number_of_rows(spark, monkeypatch):
    """A frequent head is many tasks, partitions follow the rows, and the first spans are those of a sort of all."""
    from tracewell.operators import cluster, rows

    deals = []

    def dealt(r, keys, parts):
        deals.append((tuple(keys), parts))
        return rows.dealt(r, keys, parts=50)

    monkeypatch.setattr(cluster, "dealt", dealt)
    said = [(i % 3 if i % 4 else 0, f"T{1 + i * 7 % 4}", i, f"s{i * 31 % 60}") for i in range(400)] + [(5, "T1", 1, None), (None, "T2", 2, "x")]
    named = [(i % 3, i, i * 13 % 50, "r", "", f"e{i * 17 % 40}") for i in range(300)]
    sources = spark.createDataFrame(said, "head int, tier string, id int, span string")
    entities = spark.createDataFrame(named, "head int, id int, entity int, role string, topic string, span string")
    out = cluster.head_spans(sources, entities, most=5)
    assert held(out)
    got = {r.head: r.spans for r in out.collect()}
    want = {}
    for head, span in [(x[0], x[3]) for x in sorted(said, key=lambda x: (x[1], x[2]))] + [(x[0], x[5]) for x in sorted(named, key=lambda x: (x[1], x[2]))]:
        mine = want.setdefault(head, [])
        if span not in mine and len(mine) < 5:
            mine.append(span)
    assert got == want and deals == [(("head", "part"), 1), (("head",), 1)]


def test_neighbourhood_groups_edges_once(spark):
    """Both ends of an edge are told from one group, loops and edges both ways among them."""
    from tracewell.operators import graph

    data = [("a", "r", "b", 0.5, "x", 1, 1, 7), ("a", "r", "b", 0.9, "y", 2, 2, 8), ("b", "r", "a", 0.4, "z", 3, 3, 7), ("c", "s", "c", 0.1, "w", 4, 4, 9)]
    edges = spark.createDataFrame(data, "src string, relation string, dst string, confidence double, rationale string, ts int, id int, head int")
    sources = spark.createDataFrame([(8, 1, "T2", "u1"), (8, 2, "T1", "u2"), (7, 3, "T1", "u3")], "head int, id int, tier string, url string")
    out = graph.neighbourhood(edges)
    one, two, three = (2, 0.9, "y", 2), (1, 0.4, "z", 3), (1, 0.1, "w", 4)
    want = [("a", "out", "r", "b", *one), ("b", "in", "r", "a", *one), ("b", "out", "r", "a", *two), ("a", "in", "r", "b", *two), ("c", "out", "s", "c", *three), ("c", "in", "s", "c", *three)]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    told = sorted((r.entity, r.direction, r.url) for r in graph.neighbourhood(edges, sources).collect())
    assert told == [("a", "in", "u3"), ("a", "out", "u2"), ("b", "in", "u2"), ("b", "out", "u3")]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_event_objects_groups_facts_once(spark):
    """All parts of a head come from one grouping of one scan, with repeats, nulls and heads without a part among them."""
    from tracewell.catalog import QUERIES
    from tracewell.plans import views

    nan = float("nan")
    facts = spark.createDataFrame(
        [
            (1, (5,), (9, "b", "y"), (5, "T2", "u5", "s"), (7, "t", "no", 0.5, "r"), ("q", "lean", 0.2)),
            (1, (5,), (9, "b", "x"), (5, "T2", "u5", "s"), (7, "t", "yes", 0.9, "z"), ("p", "toss", 0.2)),
            (1, (3,), (9, "b", "x"), (6, "T1", "u6", None), (7, "t", "may", 0.9, "a"), ("q", "lean", 0.7)),
            (1, None, (8, "b", None), None, (7, None, "so", None, "a"), ("z", "toss", None)),
            (1, None, (8, None, "w"), None, (7, None, "un", -1.0, "b"), ("n", "toss", nan)),
            (2, None, None, None, (1, "t", "yes", 0.9, "a"), None),
            (None, (1,), None, None, None, None),
            (4, (1,), None, None, None, None),
        ],
        "head int, member struct<id int>, entity struct<entity int, name string, role string>, source struct<id int, tier string, url string, span string>, stance struct<entity int, topic string, stance string, confidence double, role string>, race struct<race_id string, rating string, confidence double>",
    )
    heads = spark.createDataFrame([(1, "F"), (2, "O"), (3, "P"), (None, "N")], "head int, status string")
    links = spark.createDataFrame([(2, 1, "FOLLOWS", 1.0, 20, 10), (3, 1, "FOLLOWS", 1.0, 5, 10)], "src int, dst int, relation string, sim double, a int, b int")
    out = views.event_objects(heads, facts, views.related_both_ways(links, ("a", "b")))
    plain = lambda v: tuple(map(plain, v)) if isinstance(v, (list, tuple)) else "nan" if v != v else v
    got = {r["head"]: {k: plain(v) for k, v in r.asDict().items()} for r in out.collect()}
    none = dict.fromkeys(("members", "entities", "reactions", "sources", "races", "related"))
    assert got[1] == {
        "head": 1, "status": "F", "members": (3, 5), "entities": ((8, None, ("w",)), (8, "b", ()), (9, "b", ("x", "y"))),
        "reactions": ((7, None, "un", "T1", "u6"), (7, "t", "may", "T1", "u6")), "sources": (("T1", "u6", None), ("T2", "u5", "s"), ("T2", "u5", "s")),
        "races": (("n", "toss", "nan"), ("q", "lean", 0.7), ("p", "toss", 0.2), ("z", "toss", None)), "related": ((3, "later", "FOLLOWS"), (2, "later", "FOLLOWS")),
    }
    assert got[2] == none | {"head": 2, "status": "O", "related": ((1, "prior", "FOLLOWS"),)}
    assert got[3] == none | {"head": 3, "status": "P", "related": ((1, "prior", "FOLLOWS"),)} and got[None] == none | {"head": None, "status": "N"}
    plan = QUERIES["event_objects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning(l_orderkey") == 1
