"""Every operator and every pipeline stage on odd rows: nulls in any column, empty and very long texts, ties,
repeated rows, empty tables, and further columns whose names the operators use themselves."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import prose
from tracewell.llm import centroids, context_mixing, decontaminate, hard_negatives, license_scan, minhash_dedup, mixing, quality_rules, secret_scan, substring_dedup, suffix_dedup, toxicity, warc_zip

CLASHING = ("row", "version", "base", "weak", "marks", "span", "tag", "ask", "node", "label", "digest", "draw", "size", "pattern", "sid", "uses", "rest", "w", "h", "lines", "kept", "words", "places", "blocks", "own", "n", "first", "page", "contaminated", "score", "word", "rank", "again_id", "toxic", "bad")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    long = prose(rng, 120_000, 50_000)
    text = prose(rng, 90)
    texts = [None, "", " \n", "one", text, text, text + " tail", long, "x" * 300_000, "é" * 5_000, f"token={'a1' * 12} {text}", "Released under the MIT license"]
    out = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None if i % 4 == 0 else len(t or "")) for i, t in enumerate(texts)]
    # Repeated rows, a doc_id with two texts, rows without a doc_id.
    return [*out, out[4], out[4], (4, "another text under that id " + prose(rng, 50), None, None, None), (None, text, None, None, None), (None, None, None, None, None)]


def frames(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, docs.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(None, 1, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "released under the mit license"), (2, None), (None, "x" * 50)], "item_id long, text string")

    def toxic(docs):
        return toxicity.score_texts(docs, toxicity.learn(toxicity.training_rows(docs, labels)))

    def quality(docs):
        return quality_rules.judge(docs, quality_rules.learn(quality_rules.labelled_statistics(docs, labels)))

    return {
        "op1": toxic,
        "op2": lambda d: minhash_dedup.near_duplicates(d, size=4),
        "op3": lambda d: decontaminate.flag_items(d, items),
        "op4": substring_dedup.dedup_passages,
        "op5": quality,
        "op6": mixing.mix_sources,
        "op7": license_scan.scan_licenses,
        "op8": lambda d: warc_zip.read_packages(warc_zip.write_packages(d.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *[c for c in d.columns if c in CLASHING]), warc_zip.package_folder(spark))),
        "op9": secret_scan.scan_secrets,
        "op10": suffix_dedup.dedup_bytes,
        "op11": lambda d: context_mixing.score_texts(d, slot_bits=16).withColumns({c: F.round(c, 9) for c in ("base_score", "score", "bits_per_byte")}),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11"])
def test_operator(spark, rows, name):
    apply = operators(spark)[name]
    plain, clashing = frames(spark, rows)
    one, other = apply(plain), apply(clashing)
    columns = [c for c in one.columns if c not in ("payload", "spans", "text")]
    told = lambda df: sorted(map(str, df.select(columns).collect()))
    got = told(one)
    assert len(got) == len(rows)
    if name != "op3":  # which replaces a column of its own name and keeps all others
        assert told(other) == got
    else:
        assert sorted(r.contaminated for r in other.collect()) == sorted(r.contaminated for r in one.collect())
    assert apply(clashing.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, rows, tmp_path, name):
    for t, schema, data in (("labels", "doc_id long, quality int, toxic int", [(i, i % 2, 0) for i in range(12)]), ("benchmark", "item_id long, text string", [(1, "released under the mit license"), (2, None)])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    plain, clashing = frames(spark, rows)
    told = lambda df: sorted(map(str, df.collect()))
    one = stage(spark, plain, str(tmp_path))
    assert set(plain.columns) <= set(one.columns)
    got = told(one)
    assert 0 < len(got) <= len(rows) and got == told(stage(spark, clashing, str(tmp_path)))
    assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
    if name == "MinHash near-dedup":
        ids = [r.doc_id for r in one.collect()]
        assert ids.count(4) == 2 and 5 not in ids and ids.count(None) == 2


@pytest.mark.parametrize("run", [lambda d: hard_negatives.mine_negatives(d, every=5, block=16), lambda d: centroids.cluster_vectors(d, k=7, dims=4)])
def test_vectors(spark, run):
    """Nulls, vectors of other lengths and with components that do not count, repeated rows, no rows, and clashing
    names of further columns."""
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(60)]
    rows += [rows[10], rows[10], (10, rows[11][1], 1), (20, [0.0] * 4, 0), (25, rows[12][1], 0), (None, [1.0] * 4, 1), (70, None, 1), (75, [1.0, None, 1.0, 1.0], 1)]
    rows += [(80, [float("nan")] * 4, 0), (85, [float("inf"), 0.0, 0.0, 0.0], 0), (90, [1e30, 0.0, 0.0, 0.0], 0), (95, [], 0), (100, [0.5, 0.5], 2), (105, rows[3][1], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    told = lambda d: sorted(map(str, d.collect()))
    got = told(run(df))
    assert got and got == told(run(df.select("*", *[F.lit("clash").alias(c) for c in ("q", "key", "block", "chunk", "cluster", "distance", "draw", "score", "rank", "tops")])))
    assert run(df.limit(0)).count() == 0
