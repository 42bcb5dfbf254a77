"""MinHash near-dedup with tensored banding.

Two small collections of bands are computed per document, `bands` of `rows` minimum hashes each.  A
table key is a pair of bands, one from either collection, so bands * bands tables of 2 * rows hashes
cost only 2 * bands * rows hashes.  Bands that occur once are dropped before pairs are formed.

In each table, documents are compared with a leader drawn by hash, which joins large groups of copies
without all their pairs.  Documents of tables that still hold several components are then joined across
components by prefix, length and positional filters over shingles in the order of their frequency, which is
exact, so no link between components is left out, and families of documents that share a template but
fall short of the threshold make no pairs.  Every link is confirmed on the full sets, whose shingles are
compared by 62-bit fingerprints: polynomials, in two bases modulo a prime, over hashes of the words' bytes.
Documents with equal sets are one class throughout.

Recall of a pair at similarity 0.8 with the default 24 bands of 4: two times 3e-6 below 1.

Cases: texts that are null or without words have empty sets, link with nothing and are kept; fewer
words than a shingle make one shingle of the whole sequence; repeated rows belong to one class and are
kept or dropped together; rows that share a doc_id but not the text are documents of their own, told
apart by version; rows without a doc_id link with nothing and are kept; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, PrimeRolling, buffers, keyed, mix, release, stash, word_hashes, word_spans


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) for slices of texts."""
    for lo, hi, data, offsets in buffers(texts):
        start, end, first = word_spans(data, offsets)
        words = PrimeRolling(word_hashes(LOWER[data], start, end))
        n = np.diff(first)
        counts = np.maximum(n - size + 1, np.minimum(n, 1))
        at = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        stop = np.minimum(at + size, np.repeat(first[1:], counts))
        hashes = mix(words.of(at, stop) + (stop - at).astype(np.uint64))
        cut = np.concatenate([[0], np.cumsum(counts)])
        yield lo, [np.unique(hashes[cut[i] : cut[i + 1]]) for i in range(hi - lo)]


def _signatures(batches: Iterator[pa.RecordBatch], size: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(11)
    odd = rng.integers(1, 1 << 63, 2 * bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        ids, versions = batch.column("doc_id"), batch.column("version")
        for lo, sets in shingle_sets(batch.column("text"), size):
            n = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(n)
            low = np.zeros((len(sets), 2 * bands * rows), dtype=np.uint64)
            total, other = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                cut = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                for j, a in enumerate(odd):
                    low[full, j] = np.minimum.reduceat(every * a, cut)
                total[full], other[full] = np.add.reduceat(every, cut), np.add.reduceat(mix(every ^ np.uint64(0x5DEECE66D)), cut)
            low = mix(low + np.arange(low.shape[1], dtype=np.uint64)).reshape(len(sets), 2 * bands, rows)
            band = low[:, :, 0]
            for r in range(1, rows):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, :, r])
            band = mix(band + np.arange(2 * bands, dtype=np.uint64)).view(np.int64)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(np.ascontiguousarray(x).ravel()))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), versions.slice(lo, len(sets)), pa.array(n), pa.array(total.view(np.int64)), pa.array(other.view(np.int64)), lists(band[:, :bands]), lists(band[:, bands:])], ["doc_id", "version", "n_shingles", "total", "other", "a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("node")
        for lo, sets in shingle_sets(batch.column("text"), size):
            cut = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, len(sets)), pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "shingles"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of edges (x, y) can reach.  Labels spread to
    neighbours and then jump to their own label's label, until none changes."""
    both = stash(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "links")
    labels = stash(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["node"] == heard["x"]).select("node", F.least("label", "heard").alias("near"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = stash(near.join(jump, "near", "left").select("node", F.least("near", "far").alias("label"), "old"), "labels")
        labels = step.select("node", "label")
        if step.where("label < old").limit(1).count() == 0:
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, label) after further links (x, y): components of what the labels leave apart."""
    if labels is None:
        return components(links)
    a = labels.select(F.col("node").alias("x"), F.col("label").alias("label_x"))
    b = labels.select(F.col("node").alias("y"), F.col("label").alias("label_y"))
    apart = links.join(a, "x", "left").join(b, "y", "left").select(F.coalesce("label_x", "x").alias("x"), F.coalesce("label_y", "y").alias("y")).where("x <> y")
    above = components(apart)
    moved = labels.join(above.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return stash(moved.union(above.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")


def _node() -> Column:
    """One number for a document: its doc_id, or a hash where others share that."""
    return F.when(F.col("version") == 0, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "version"))


def _shared(bands: DataFrame) -> DataFrame:
    """bands (node, band) without those that only one row has."""
    again = bands.groupBy("band").count().where("count >= 2").select("band")
    return bands.join(again, "band", "left_semi")


def _prefix_pairs(ranked: DataFrame, percent: int, step: float = 1.02) -> DataFrame:
    """(x, y) of all rows of ranked (node, n, label, own: what of its set others may share, as (often, shingle), rarest
    first) with different labels whose sets, of n shingles each, can reach the similarity.

    Sets of n <= m shingles must share need(n, m) of them, so the smaller set's first n - need + 1, what nobody
    shares before all else, hold one of these, and so do the larger one's first.  The need grows with m, so
    the smaller set asks for each step of sizes by itself, and for a common part that falls short of it
    asks with nothing.  What is left of both sets after the place of a shingle bounds what they share."""
    need = lambda n, m: F.ceil(percent * (n + m) / (100 + percent))
    n, at = F.col("n"), F.col("n") - F.size("own") + F.col("place") + 1
    rows = ranked.where(100 * F.size("own") >= percent * n).select("node", "label", "n", "own", F.posexplode("own").alias("place", "one")).select("node", "label", "n", at.alias("at"), F.col("one.shingle").alias("shingle"))
    rows = stash(rows.where(F.col("at") <= n - F.ceil(percent * n / 100) + 1), "prefixes")
    size_step = lambda m: F.floor(F.log(m.cast("double")) / math.log(step)).cast("int")
    steps = F.filter(F.sequence(size_step(n), size_step(F.floor(100 * n / percent))), lambda b: F.col("at") <= n - need(n, F.greatest(n, F.floor(F.pow(F.lit(step), b)))) + 1)
    asking = rows.select(F.col("node").alias("x"), F.col("label").alias("label_x"), "n", F.col("at").alias("i"), "shingle", F.explode(steps).alias("step"))
    asked = rows.select(F.col("node").alias("y"), F.col("label").alias("label_y"), F.col("n").alias("m"), F.col("at").alias("j"), "shingle", size_step(n).alias("step"))
    m = F.col("m")
    able = (F.col("label_x") != F.col("label_y")) & (m >= n) & (percent * m <= 100 * n) & (1 + F.least(n - F.col("i"), m - F.col("j")) >= need(n, m))
    return asking.join(asked, ["shingle", "step"]).where(able).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, rounds: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, version (see common.keyed), n_shingles,
    component_id, kept, leader.  Documents link with 100 * |both| >= percent * |either| of their sets of
    `size`-word shingles; component_id is the smallest doc_id that links reach, kept says that the row has
    it, and leader that it is the first by (doc_id, version) among all rows with that component."""
    docs = keyed(docs)
    schema = "doc_id long, version long, n_shingles long, total long, other long, a array<long>, b array<long>"
    signed = stash(docs.mapInArrow(partial(_signatures, size=size, bands=bands, rows=rows), schema), "signatures")
    key = ["n_shingles", "total", "other"]
    full = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy(key).agg(F.min(F.struct("doc_id", "version", "a", "b")).alias("first")).select(*key, "first.*")
    classes = stash(classes.withColumn("node", _node()), "classes")
    # Bands that two classes share, first of one collection, then of the other among what is left.
    a = _shared(classes.select("node", F.explode("a").alias("band"))).groupBy("node").agg(F.collect_list("band").alias("a"))
    left = stash(classes.select("node", "b", F.col("n_shingles").alias("n")).join(a, "node"), "bands-a")
    b = _shared(left.select("node", F.explode("b").alias("band"))).groupBy("node").agg(F.collect_list("band").alias("b"))
    pairs = left.drop("b").join(b, "node")
    keys = pairs.select("node", "n", "a", F.explode("b").alias("b")).select("node", "n", "b", F.explode("a").alias("a")).select("node", "n", F.xxhash64("a", "b").alias("key"))
    tables = keys.groupBy("key").count().where("count >= 2").select("key")
    keys = stash(keys.join(tables, "key", "left_semi"), "table-keys")
    fits = lambda n, m: (100 * F.least(n, m) >= percent * F.greatest(n, m))
    wanted = keys.select("node").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).select(_node().alias("node"), "text")
    sets = stash(named.join(wanted, "node", "left_semi").mapInArrow(partial(_sets, size=size), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("s")), "x").join(sets.select(F.col("node").alias("y"), F.col("shingles").alias("t")), "y")
        common = F.size(F.array_intersect("s", "t"))
        return both.select("x", "y", common.alias("c"), (F.size("s") + F.size("t") - common).alias("u")).where(100 * F.col("c") >= percent * F.col("u")).select("x", "y")

    def placed(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows.withColumn("label", F.col("node"))
        return rows.join(labels, "node", "left").select(*rows.columns, F.coalesce("label", "node").alias("label"))

    # Stars: in each round a part of the tables, each led by its first document in an order that is
    # drawn anew, the same in all tables, so that a document meets few leaders.
    labels, tested = None, None
    for turn in range(rounds):
        here = placed(keys.where(F.pmod("key", F.lit(rounds)) == turn), labels)
        lead = here.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("draw"), F.col("node").alias("lead"), F.col("n").alias("m"), F.col("label").alias("lead_label"))).alias("first")).select("key", "first.*")
        star = here.join(lead, "key").where((F.col("label") != F.col("lead_label")) & fits(F.col("n"), F.col("m"))).select(F.least("node", "lead").alias("x"), F.greatest("node", "lead").alias("y")).distinct()
        star = stash(star if tested is None else star.join(tested, ["x", "y"], "left_anti"), "pairs")
        tested = star if tested is None else tested.union(star)
        found = stash(confirmed(star), "confirmed")
        labels = merged(labels, found)
    # Documents of tables that still hold several components are joined across components, by shingles
    # that several components have.
    every = placed(keys, labels)
    mixed = every.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("key")
    who = stash(every.join(mixed, "key", "left_semi").select("node", "n", "label").distinct(), "unsettled")
    release(keys)
    held = sets.join(who, "node").select("node", "n", "label", F.explode("shingles").alias("shingle"))
    wide = held.groupBy("shingle").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("often")).where("p < q").select("shingle", "often")
    ranked = held.join(wide, "shingle").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("own"))
    cross = stash(_prefix_pairs(ranked, percent), "crossing")
    more = stash(confirmed(cross.join(tested, ["x", "y"], "left_anti")), "confirmed")
    if more.limit(1).count():
        labels = merged(labels, more)
    placed_classes = classes.select(*key, "doc_id", "version", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    firsts = placed_classes.groupBy("label").agg(F.min(F.struct("doc_id", "version")).alias("lead"))
    found = placed_classes.select(*key, "label").join(firsts, "label").select(*key, "lead")
    out = signed.select("doc_id", "version", *key).join(found, key, "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = out.select("doc_id", "version", "n_shingles", F.when(linked, F.col("lead.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(linked, F.struct("doc_id", "version") == F.col("lead")).otherwise(F.lit(True)).alias("leader"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
