"""Similarity in time windows, leader clustering and roll-ups of heads."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.columns import band, epoch_us, lookup, unit
from tracewell.operators.rows import dealt, first_per_key, kept
from tracewell.params import KNOBS, TIER_WEIGHT

#: Rows of a block, of 64 components about 17 MB: the more, the less often a row is sent.
BLOCK = 32_768


def _matrix(t: pa.Table) -> np.ndarray:
    flat = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1)


def _chosen(row: np.ndarray, col: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar entries of each row, equal ones by column; and the rank of each from 0."""
    order = np.lexsort((col, -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = rank < k
    return row[keep], col[keep], sim[keep], rank[keep]


def _best(left: tuple, right: tuple, width: int, k: int, digits: int | None, earlier: bool, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and similarity of the k best of right (id, at, vectors; in the order of id) for each row of left
    that are no less than its floor.  Products are of about a million cells each, of which only what reaches the
    kth similarity of its row so far is looked at."""
    a, ta, va = left
    b, tb, vb = right
    slack = 0.0 if digits is None else 10.0**-digits
    found = []
    for top in range(0, len(a), 1024):
        here = slice(top, top + 1024)
        n = len(a[here])
        least = np.full(n, -np.inf) if floor is None else floor[here].copy()
        row, col, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        step = max(1024, (1 << 20) // n)
        for at in range(0, len(b), step):
            there = slice(at, at + step)
            sim = va[here] @ vb[there].T
            t, u = ta[here], tb[there]
            apart = a[here][:, None] == b[there][None, :]
            if earlier or max(t.max(), u.max()) - min(t.min(), u.min()) > width:
                apart |= np.abs(t[:, None] - u[None, :]) > width
            if earlier:
                apart |= (u[None, :] > t[:, None]) | ((u[None, :] == t[:, None]) & (b[there][None, :] > a[here][:, None]))
            sim[apart] = -np.inf
            bar = least
            if sim.shape[1] > k and np.isneginf(least).any():
                bar = np.maximum(least, np.partition(sim, -k, axis=1)[:, -k] - slack)
            i, j = np.nonzero((sim >= bar[:, None]) & (sim > -np.inf))
            if len(i):
                new = sim[i, j] if digits is None else np.round(sim[i, j], digits)
                row, col, best, rank = _chosen(np.concatenate([row, i]), np.concatenate([col, j + at]), np.concatenate([best, new]), k)
                last = rank == k - 1
                least[row[last]] = np.maximum(least[row[last]], best[last] - slack)
        found.append((row + top, col, best))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


NEAR = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("sim", pa.float64())])


def _parts(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.column("id").to_numpy(), t.column("at").to_numpy(), _matrix(t)


def _unit(t: pa.Table) -> np.ndarray:
    """The vectors scaled to length 1, zero vectors as they are: the same doubles as columns.unit gives."""
    x = _matrix(t).astype(np.float64)
    total = np.zeros(len(x))
    for column in x.T:
        total += column * column
    norm = np.sqrt(total)
    norm[norm == 0] = 1.0
    x /= norm[:, None]
    return x


def _nearest(width: int, k: int, digits: int | None, earlier: bool, scaled: bool = True):
    """Of two blocks the k nearest rows of the second for each row of the first; vectors that are not scaled yet
    are scaled here."""

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return NEAR.empty_table()
        right = right.sort_by("id")
        a, b = _parts(left), _parts(right)
        if not scaled:
            a, b = (*a[:2], _unit(left)), (*b[:2], _unit(right))
        row, col, sim = _best(a, b, width, k, digits, earlier)
        return pa.table([a[0][row], b[0][col], sim + 0.0], schema=NEAR)

    return nearest


def _block_pairs(far: DataFrame, near: DataFrame, group: list[str], block: int):
    """far and near (id, group, ...) dealt to blocks of about `block` rows of their group and grouped by pairs of
    blocks, for cogroup."""
    blocks = F.ceil(F.count(F.lit(1)) / block).cast("int")
    sizes = near.groupBy(*group).agg(blocks.alias("n_right")).join(far.groupBy(*group).agg(blocks.alias("n_left")), group)
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = far.join(sizes, group).select(*[F.col(c).alias(c) for c in far.columns], dealt("n_left").alias("l"), each("n_right").alias("r"))
    right = near.join(sizes, group).select(*near.columns, dealt("n_right").alias("r"), each("n_left").alias("l"))
    return left.groupBy(*group, "l", "r").cogroup(right.groupBy(*group, "l", "r"))


def window_neighbours(left: DataFrame, right: DataFrame, hours: int = KNOBS.window_hours, k: int = KNOBS.knn, digits: int | None = None, earlier: bool = False, block: int = BLOCK) -> DataFrame:
    """For each row of left the k rows of right with the most similar vectors among those within the
    hours (C5): id, neighbour, sim, rank; with earlier only rows before it by (ts, id).  Both sides: id, ts,
    embedding, all of one length.

    The window is a stretch of its own width and the ones beside it.  The rows of a stretch are dealt to
    blocks of about `block`, each pair of blocks is one task's work, product by product, which keeps k rows
    for each, and these are merged by id; so a crowded stretch is many bounded tasks, and a row is sent once for
    each block of the other side."""
    width = hours * 3_600_000_000
    stretch = F.floor(epoch_us("ts") / width)
    # As they are: floats are half of what their scaled doubles are.
    columns = [F.col("id").cast("long").alias("id"), epoch_us("ts").alias("at"), F.col("embedding").alias("vector")]
    beside = (stretch - 1, stretch) if earlier else (stretch - 1, stretch, stretch + 1)
    near = right.where("embedding is not null and ts is not null").select(*columns, stretch.alias("stretch"))
    far = left.where("embedding is not null and ts is not null").select(*columns, F.explode(F.array(*beside)).alias("stretch"))
    pairs = _block_pairs(far, near, ["stretch"], block).applyInArrow(_nearest(width, k, digits, earlier, scaled=False), "id long, neighbour long, sim double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _to_pivots(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """rows with the pivot that each is nearest to, and the angle to it."""
    schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("vector", pa.list_(pa.float64())), ("stretch", pa.int64()), ("cell", pa.int32()), ("angle", pa.float64())])
    if not rows.num_rows or not pivots.num_rows:
        return schema.empty_table()
    pivots = pivots.sort_by("pivot")
    v, w = _matrix(rows), _matrix(pivots)
    near, most = np.empty(len(v), np.int64), np.empty(len(v))
    step = max(1, (1 << 20) // len(w))
    for at in range(0, len(v), step):
        sim = v[at : at + step] @ w.T
        near[at : at + step] = sim.argmax(axis=1)
        most[at : at + step] = sim.max(axis=1)
    angle = np.arccos(np.clip(most, -1.0, 1.0))
    cell = pivots.column("pivot").to_numpy()[near].astype(np.int32)
    return pa.table([rows.column("id"), rows.column("at"), rows.column("vector"), rows.column("stretch"), pa.array(cell), pa.array(angle)], schema=schema)


def _able(slack: float):
    """Of the cells (cell, vector of the pivot, radius, least) of two groups those pairs that can matter."""

    def able(asked: pa.Table, held: pa.Table) -> np.ndarray:
        angle = np.arccos(np.clip(_matrix(asked) @ _matrix(held).T, -1.0, 1.0))
        left = angle - asked.column("radius").to_numpy()[:, None] - held.column("radius").to_numpy()[None, :]
        out = np.cos(np.maximum(left, 0.0)) + slack >= asked.column("least").to_numpy()[:, None]
        return out & (asked.column("cell").to_numpy()[:, None] != held.column("cell").to_numpy()[None, :])

    return able


def _told(slack: float):
    """How many pairs of cells there are between two groups, and how many are multiplied, a cell with itself included."""
    able = _able(slack)

    def told(asked: pa.Table, held: pa.Table) -> pa.Table:
        schema = pa.schema([("stretch", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("pairs", pa.int64()), ("multiplied", pa.int64()), ("rest", pa.int64())])
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        rest = int(able(asked, held).sum())
        same = len(np.intersect1d(asked.column("cell").to_numpy(), held.column("cell").to_numpy()))
        key = [asked.column(c)[0].as_py() for c in ("stretch", "l", "r")]
        return pa.table([[x] for x in (*key, asked.num_rows * held.num_rows, rest + same, rest)], schema=schema)

    return told


def _nearest_of_cells(width: int, k: int, digits: int | None, slack: float):
    """Of two blocks, whose rows without an id are the cells of their groups, the k nearest rows of other cells that
    can matter for each row of the first."""
    able = _able(slack)

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, held = (t.filter(pc.is_null(t.column("id"))) for t in (left, right))
        left, right = (t.filter(pc.is_valid(t.column("id"))) for t in (left, right))
        if not left.num_rows or not right.num_rows:
            return NEAR.empty_table()
        asked, left, right = asked.sort_by("cell"), left.sort_by("cell"), right.sort_by("id")
        may = able(asked, held)
        place = np.full(held.column("cell").to_numpy().max() + 1, -1)
        place[held.column("cell").to_numpy()] = np.arange(held.num_rows)
        a, b = _parts(left), _parts(right)
        cells, there = left.column("cell").to_numpy(), place[right.column("cell").to_numpy()]
        floor = left.column("least").to_numpy() - slack
        out = []
        for at, cell in enumerate(asked.column("cell").to_numpy()):
            here = slice(*np.searchsorted(cells, [cell, cell + 1]))
            cols = np.flatnonzero(may[at][there])
            if here.start < here.stop and len(cols):
                row, col, sim = _best(tuple(x[here] for x in a), b if len(cols) == len(there) else tuple(x[cols] for x in b), width, k, digits, False, floor[here])
                out.append((a[0][here][row], b[0][cols[col]], sim + 0.0))
        return pa.table([np.concatenate(x) for x in zip(*out)], schema=NEAR) if out else NEAR.empty_table()

    return nearest


def pruned_neighbours(left: DataFrame, right: DataFrame, folder: str, hours: int = KNOBS.window_hours, k: int = KNOBS.knn, digits: int | None = None, block: int = 1024, dealt: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """window_neighbours without products of cells that cannot matter (C5), and for each stretch the pairs of cells
    that there are and those that were multiplied: stretch, pairs, multiplied.

    The vectors of a stretch gather around pivots, one for each `block` rows, drawn by hash; the angle from a pivot to
    the farthest of its cell is the cell's radius.  A row's own cell comes first.  Angles obey the triangle
    inequality, so no row of cell l is more similar to one of cell r than the cosine of what is left of the
    angle between the pivots without both radii; where that is below the kth similarity that every row of l
    has found by then, the pair is not multiplied.

    Cells are far smaller than what a task can hold, so groups of them of about `dealt` rows are dealt out, crowded
    ones in parts by hash, and a row is sent once for each group that has any cell for it."""
    width = hours * 3_600_000_000
    stretch = F.floor(epoch_us("ts") / width)
    columns = [F.col("id").cast("long").alias("id"), epoch_us("ts").alias("at"), unit(F.transform("embedding", lambda x: x.cast("double"))).alias("vector")]
    near = kept(right.where("embedding is not null and ts is not null").select(*columns, stretch.alias("stretch")), folder, "near")
    far = left.where("embedding is not null and ts is not null").select(*columns, F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    count = F.count(F.lit(1))
    sizes = near.groupBy("stretch").agg(F.ceil(count / block).cast("int").alias("blocks"), F.ceil(count / dealt).cast("int").alias("parts"))
    drawn = F.row_number().over(Window.partitionBy("stretch").orderBy(F.xxhash64("id", F.lit("pivot")), "id"))
    drawn = near.select("id", "stretch").withColumn("pivot", drawn).join(sizes, "stretch").where(F.col("pivot") <= F.col("blocks"))
    pivots = kept(near.join(drawn, ["stretch", "id"]).select("stretch", "pivot", "vector", "parts"), folder, "pivots")
    shape = "id long, at long, vector array<double>, stretch long, cell int, angle double"

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        spread = rows.join(sizes, "stretch").select("id", "at", "vector", "stretch", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
        each = pivots.select("stretch", "pivot", "vector", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return kept(spread.groupBy("stretch", "part").cogroup(each.groupBy("stretch", "part")).applyInArrow(_to_pivots, shape), folder, name)

    near, far = gathered(near, "near-cells"), gathered(far, "far-cells")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    own = _block_pairs(far.drop("angle"), near.drop("angle"), ["stretch", "cell"], dealt).applyInArrow(_nearest(width, k, digits, False), "id long, neighbour long, sim double")
    first = kept(best(own), folder, "own-cells")
    least = first.groupBy("id").agg(F.min("sim").alias("least"), count.alias("n")).where(F.col("n") >= k).select("id", "least")
    far = kept(far.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), folder, "far-asking")
    of = lambda rows, low: rows.groupBy("stretch", "cell").agg(F.max("angle").alias("radius"), low.alias("least"))
    middle = pivots.select("stretch", F.col("pivot").cast("int").alias("cell"), "vector")
    # Cells in their numbers' order, which is that of a hash.
    group = F.floor((F.col("cell") - 1) / max(1, dealt // block)).cast("int")
    asked = kept(of(far, F.min("least")).join(middle, ["stretch", "cell"]).withColumn("l", group), folder, "asking-cells")
    held = kept(of(near, F.lit(-2.0)).join(middle, ["stretch", "cell"]).withColumn("r", group), folder, "held-cells")
    groups = asked.select("stretch", "l").distinct().join(held.select("stretch", "r").distinct(), "stretch")
    groups = kept(groups, folder, "groups")
    # Rounding of angles and similarities is far below the slack.
    slack = 1e-6 + (0.5 * 10.0**-digits if digits is not None else 0.0)
    pairs = asked.join(groups, ["stretch", "l"]).groupBy("stretch", "l", "r").cogroup(held.join(groups, ["stretch", "r"]).groupBy("stretch", "l", "r"))
    told = kept(pairs.applyInArrow(_told(slack), "stretch long, l int, r int, pairs long, multiplied long, rest long"), folder, "group-pairs")
    apart = told.where("rest > 0").select("stretch", F.col("l").alias("lg"), F.col("r").alias("rg"))
    group_of = lambda rows, name: rows.withColumn(name, group)
    parts = lambda rows, name: rows.groupBy("stretch", name).agg(F.ceil(count / dealt).cast("int").alias(f"n_{name}"))
    a, b = group_of(far, "lg"), group_of(near.withColumn("least", F.lit(-2.0)), "rg")
    apart = kept(apart.join(parts(a, "lg"), ["stretch", "lg"]).join(parts(b, "rg"), ["stretch", "rg"]), folder, "apart")
    key = ["stretch", "lg", "rg", "l", "r"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    shown = ["id", "at", "vector", "cell", "least", F.lit(None).cast("double").alias("radius")]
    cell = [F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("at"), "vector", "cell", "least", "radius"]
    rows_l = a.join(apart, ["stretch", "lg"]).select("stretch", "lg", "rg", hashed("n_lg").alias("l"), each("n_rg").alias("r"), *shown)
    rows_r = b.join(apart, ["stretch", "rg"]).select("stretch", "lg", "rg", each("n_lg").alias("l"), hashed("n_rg").alias("r"), *shown)
    both = apart.select("stretch", "lg", "rg", each("n_lg").alias("l"), "n_rg").select("stretch", "lg", "rg", "l", each("n_rg").alias("r"))
    cells_l = asked.drop("l").withColumn("lg", group).join(both, ["stretch", "lg"]).select(*key, *cell)
    cells_r = held.drop("r").withColumn("rg", group).join(both, ["stretch", "rg"]).select(*key, *cell)
    rest = rows_l.unionByName(cells_l).groupBy(*key).cogroup(rows_r.unionByName(cells_r).groupBy(*key)).applyInArrow(_nearest_of_cells(width, k, digits, slack), "id long, neighbour long, sim double")
    counted = told.groupBy("stretch").agg(F.sum("pairs").alias("pairs"), F.sum("multiplied").alias("multiplied"))
    return best(first.drop("rank").union(rest)), counted


def candidate_clusters(neighbours: DataFrame, clusters: DataFrame, entities: DataFrame, cluster_entities: DataFrame, least: int = KNOBS.min_overlap) -> DataFrame:
    """neighbours reduced to clusters (C6, C7): id, cluster, sim, overlap, rank, decision.  clusters: id,
    cluster; entities: id, entity; cluster_entities: cluster, entity."""
    best = neighbours.join(clusters.select(F.col("id").alias("neighbour"), "cluster"), "neighbour").groupBy("id", "cluster").agg(F.max("sim").alias("sim"))
    # From the near clusters to both sides' entities, so that an entity of many events pairs nothing.
    shared = best.join(entities.select("id", "entity").distinct(), "id").join(cluster_entities.select("cluster", "entity").distinct(), ["cluster", "entity"])
    met = shared.groupBy("id", "cluster", "sim").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "cluster"))
    return met.withColumn("rank", rank).withColumn("decision", band(F.col("sim")))


def settled(candidates: DataFrame, verdicts: DataFrame, least: float = KNOBS.tiebreak_confidence) -> DataFrame:
    """candidates (id, cluster, decision) with attach and review (C7, C8): a tie attaches where verdicts (id,
    cluster, same, confidence) say so with enough confidence, and goes to review where they say it with
    less; without a verdict it splits."""
    told = candidates.join(verdicts.select("id", "cluster", "same", F.col("confidence").alias("_sure")), ["id", "cluster"], "left")
    tie, sure = F.col("decision") == "TIEBREAK", F.coalesce(F.col("_sure") >= least, F.lit(False))
    attach = (F.col("decision") == "ATTACH") | (tie & sure & F.coalesce("same", F.lit(False)))
    return told.withColumn("attach", attach).withColumn("review", tie & F.col("_sure").isNotNull() & ~sure).drop("same", "_sure")


def heads_only(events: DataFrame) -> DataFrame:
    """The events (id, cluster_id) that are heads of their clusters."""
    return events.where("cluster_id = id")


def embedding_texts(events: DataFrame, sources: DataFrame, entities: DataFrame, most: int = KNOBS.embed_chars) -> DataFrame:
    """id, text: headline of events (id, headline), then the spans of sources (id, source_id, span) and of
    entities (id, entity_id, role, topic, span), in order, without repeats, at most `most` characters (C1)."""
    a = sources.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "span"))), lambda x: x["span"]).alias("a"))
    b = entities.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("entity_id", "role", "topic", "span"))), lambda x: x["span"]).alias("b"))
    none = F.array().cast("array<string>")
    parts = F.array_distinct(F.concat(F.array("headline"), F.coalesce("a", none), F.coalesce("b", none)))
    return events.select("id", "headline").join(a, "id", "left").join(b, "id", "left").select("id", F.substring(F.array_join(parts, "\n"), 1, most).alias("text"))


def text_hash(model: str, text: Column) -> Column:
    """SHA-256 of the model's name, a line end and the text."""
    return F.sha2(F.concat(F.lit(model + "\n"), text), 256)


def head_sources(sources: DataFrame) -> DataFrame:
    """sources of members (head, id, tier, url, span) as those of heads: one for each (url, span), of the best
    tier, then the least id (C11)."""
    return first_per_key(sources, ["head", "url", "span"], F.col("tier"), F.col("id"))


def _components(edges: DataFrame, folder: str) -> DataFrame:
    """(id, component): labels spread over edges (a, b) and jump until none changes; each round is a
    table in the folder, so a lost executor costs one round at most."""
    def put(df: DataFrame) -> DataFrame:
        return kept(df, folder, "components")

    both = put(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    label = put(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")))
    while True:
        heard = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("heard"))
        near = label.join(heard, label["id"] == heard["a"]).select("id", F.least("label", "heard").alias("near"), F.col("label").alias("old"))
        far = label.select(F.col("id").alias("near"), F.col("label").alias("far"))
        step = put(near.join(far, "near", "left").select("id", F.least("near", "far").alias("label"), "old"))
        label = step.select("id", "label")
        if step.where("label < old").limit(1).count() == 0:
            return label.withColumnRenamed("label", "component")


def place_in_order(rows: list[tuple], edges: dict, low: float, high: float, least: int, verdicts: dict) -> dict:
    """{id: head} by the sequential rule: rows (time, id, entities) in order; edges {id: [(neighbour,
    sim)]} nearest first; a tie in the band attaches only where verdicts[id, head] says so."""
    head: dict = {}
    held: dict = {}
    for _, i, own in sorted(rows, key=lambda r: (r[0], r[1])):
        best: dict = {}
        for other, sim in edges.get(i, ()):
            if other in head:
                best[head[other]] = max(best.get(head[other], -2.0), sim)
        choice = sorted((-s, h) for h, s in best.items() if len(own & held[h]) >= least)
        target = i
        if choice and -choice[0][0] >= low:
            sim, h = -choice[0][0], choice[0][1]
            if sim >= high or verdicts.get((i, h), False):
                target = h
        head[i] = target
        held[target] = held.get(target, set()) | own
    return head


def placed_in_rounds(rows: DataFrame, near: DataFrame, folder: str, low: float = KNOBS.t_low, high: float = KNOBS.t_high, least: int = KNOBS.min_overlap, verdicts: DataFrame | None = None, sure: float = KNOBS.tiebreak_confidence, fixed: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """The sequential rule by joins alone: rows (id, ts, entities) with near (id, neighbour, sim), their nearest among
    the rows before them, as id, head, candidate, sim, overlap, decision, review (C7-C9).

    Each round decides every row anew from the heads that the last round gave its neighbours, and from when
    each entity first came to each head; it looks back only, so the first row is right after one round, and
    what rests on right rows is right in the next.  Once no head changes, the result is the sequential one.
    Rounds are as many as the longest chain of decisions that rest on each other; no group is read whole.

    fixed (id, neighbour's head, sim) and members (head, entity) are what was placed before all rows: heads of
    stored neighbours, and the entities of those heads."""
    spark = rows.sparkSession
    order = F.struct(epoch_us("ts").alias("at"), "id")
    # Each round reads these anew, so what they rest on is computed once.
    rows, near = kept(rows.select("id", "ts", "entities"), folder, "rows"), kept(near.select("id", "neighbour", "sim"), folder, "near")
    asking = near.select("id").union(fixed.select("id")).distinct() if fixed is not None else near.select("id").distinct()
    own = kept(rows.select("id", order.alias("order"), F.explode(F.array_distinct("entities")).alias("entity")), folder, "entities")
    mine = kept(own.join(asking, "id", "left_semi"), folder, "asking")
    told = kept(verdicts.select("id", F.col("cluster").alias("candidate"), "same", "confidence"), folder, "verdicts") if verdicts is not None else spark.createDataFrame([], "id long, candidate long, same boolean, confidence double")
    heads = rows.select("id", F.col("id").alias("head"))
    while True:
        met = near.join(heads.select(F.col("id").alias("neighbour"), "head"), "neighbour").select("id", "head", "sim")
        if fixed is not None:
            met = met.union(fixed.select("id", "head", "sim"))
        met = met.groupBy("id", "head").agg(F.max("sim").alias("sim"))
        came = own.join(heads, "id").groupBy("head", "entity").agg(F.min("order").alias("came"))
        if members is not None:
            before = members.select("head", "entity", F.lit(None).cast(came.schema["came"].dataType).alias("came"))
            # Placed before all rows, whatever their time.
            came = came.union(before).groupBy("head", "entity").agg(F.when(F.bool_or(F.col("came").isNull()), F.lit(None)).otherwise(F.min("came")).alias("came"))
        shared = met.join(mine, "id").join(came, ["head", "entity"]).where(F.col("came").isNull() | (F.col("came") < F.col("order")))
        able = shared.groupBy("id", "head", "sim").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
        best = able.groupBy("id").agg(F.max_by(F.struct(F.col("head").alias("candidate"), "sim", "overlap"), F.struct("sim", -F.col("head"))).alias("best")).select("id", "best.*")
        tie = F.col("decision") == "TIEBREAK"
        judged = best.withColumn("decision", band(F.col("sim"), low, high)).join(told, ["id", "candidate"], "left")
        certain = F.coalesce(F.col("confidence") >= sure, F.lit(False))
        attach = (F.col("decision") == "ATTACH") | (tie & certain & F.coalesce("same", F.lit(False)))
        judged = judged.withColumn("attach", attach).withColumn("review", tie & F.col("confidence").isNotNull() & ~certain).drop("same", "confidence")
        now = rows.select("id").join(judged, "id", "left")
        now = now.select("id", F.when(F.col("attach"), F.col("candidate")).otherwise(F.col("id")).alias("head"), "candidate", "sim", "overlap", F.coalesce("decision", F.lit("NEW")).alias("decision"), F.coalesce("review", F.lit(False)).alias("review"))
        now = kept(now, folder, "placed")
        if not now.join(heads.select("id", F.col("head").alias("was")), "id").where("head <> was").limit(1).count():
            return now
        heads = now.select("id", "head")


def leader_clusters(rows: DataFrame, folder: str, low: float = KNOBS.t_low, high: float = KNOBS.t_high, hours: int = KNOBS.window_hours, k: int = KNOBS.knn, least: int = KNOBS.min_overlap, verdicts: DataFrame | None = None, sure: float = KNOBS.tiebreak_confidence, group: int = 5_000) -> DataFrame:
    """rows (id, ts, embedding, entities) as id, head (C9); rows without a vector or time lead themselves.  A tie
    attaches where verdicts (id, cluster, same, confidence) say so with `sure` confidence.

    A row looks at its k nearest among the earlier ones, all of which are placed by then, so neighbours
    are found in Spark; only similarities of low or more can decide, so rows split into components.  Those
    of at most `group` rows are one task's work each; larger ones are placed in rounds of joins."""
    pairs = window_neighbours(rows, rows, hours, k, earlier=True).where(F.col("sim") >= low).select(F.col("id").alias("a"), F.col("neighbour").alias("b"), "sim", "rank")
    pairs = kept(pairs, folder, "neighbours")
    part = _components(pairs, folder)
    sizes = kept(part.groupBy("component").count(), folder, "sizes")
    large = part.join(sizes.where(F.col("count") > group), "component", "left_semi").select("id")
    small = part.join(sizes.where(F.col("count") <= group), "component", "left_semi")
    near = pairs.groupBy("a").agg(F.collect_list(F.struct("rank", "b", "sim")).alias("near"))
    full = rows.select("id", "ts", "entities").join(small, "id").join(near, F.col("id") == F.col("a"), "left").drop("a")
    if verdicts is not None:
        yes = verdicts.where(F.col("same") & (F.col("confidence") >= sure)).groupBy("id").agg(F.collect_set("cluster").alias("same_as"))
        full = full.join(yes, "id", "left")
    else:
        full = full.withColumn("same_as", F.lit(None).cast("array<bigint>"))

    def place(one: pd.DataFrame) -> pd.DataFrame:
        edges = {i: [(x["b"], x["sim"]) for x in sorted(n, key=lambda x: x["rank"])] for i, n in zip(one["id"], one["near"]) if isinstance(n, (list, np.ndarray))}
        told = {(i, h): True for i, heads in zip(one["id"], one["same_as"]) if isinstance(heads, (list, np.ndarray)) for h in heads}
        head = place_in_order(list(zip(one["ts"], one["id"], map(set, one["entities"]))), edges, low, high, least, told)
        return pd.DataFrame({"id": list(head), "head": list(head.values())})

    placed = full.groupBy("component").applyInPandas(place, "id long, head long")
    if sizes.where(F.col("count") > group).limit(1).count():
        chosen = rows.select("id", "ts", "entities").join(large, "id", "left_semi")
        edges = pairs.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "sim").join(large, "id", "left_semi")
        placed = placed.unionByName(placed_in_rounds(chosen, edges, folder, low, high, least, verdicts, sure).select("id", "head"))
    return rows.select("id").join(placed, "id", "left").select("id", F.coalesce("head", "id").alias("head"))


def placements(new: DataFrame, stored: DataFrame, members: DataFrame, folder: str, low: float = KNOBS.t_low, high: float = KNOBS.t_high, hours: int = KNOBS.window_hours, k: int = KNOBS.knn, least: int = KNOBS.min_overlap, verdicts: DataFrame | None = None, sure: float = KNOBS.tiebreak_confidence) -> DataFrame:
    """new (id, ts, embedding, entities) placed among stored (id, ts, embedding, head) and members (head,
    entity), whose rows never move: id, head, candidate, sim, overlap, decision, review (T2, C6-C9).

    A row's neighbours are the k nearest within the hours, on either side in time among stored rows, and
    earlier ones among new rows.  Rows without a vector are not placed."""
    new = new.where("embedding is not null and ts is not null")
    among = window_neighbours(new, new, hours, k, earlier=True).select("id", "neighbour", "sim", F.lit(None).cast("bigint").alias("head"))
    back = window_neighbours(new, stored, hours, k).join(stored.select(F.col("id").alias("neighbour"), "head"), "neighbour").select("id", "neighbour", "sim", "head")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    near = among.union(back).withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("sim") >= low)).drop("rank")
    near = kept(near, folder, "neighbours")
    fixed = near.where("head is not null").select("id", "head", "sim")
    known = kept(members.join(fixed.select("head").distinct(), "head", "left_semi").select("head", "entity").distinct(), folder, "members")
    return placed_in_rounds(new.select("id", "ts", "entities"), near.where("head is null").select("id", "neighbour", "sim"), folder, low, high, least, verdicts, sure, fixed, known)


def placement_reviews(placed: DataFrame, events: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Ties that verdicts (id, cluster, confidence, reason) settled with too little confidence, of events (id,
    headline, doc_id), as review rows; events of no document have none (C8): doc_id, kind, mention, field,
    payload, confidence."""
    open_ones = placed.where("review").select("id", F.col("candidate").alias("cluster"), "sim")
    both = open_ones.join(verdicts.select("id", "cluster", "same", "reason", "confidence"), ["id", "cluster"]).join(events.where("doc_id is not null").select("id", "headline", "doc_id"), "id")
    payload = F.to_json(F.struct(F.col("id").alias("event_id"), F.col("cluster").alias("cluster_id"), F.col("sim").alias("similarity"), "same", "reason", "confidence"))
    return both.select("doc_id", F.lit("low_confidence").alias("kind"), F.col("headline").alias("mention"), F.lit("cluster").alias("field"), payload.alias("payload"), "confidence")


def centroids(vectors: DataFrame, head: str, digits: int | None = None) -> DataFrame:
    """head, centroid: the mean of its vectors, element by element."""
    each = vectors.select(head, F.posexplode("embedding").alias("at", "x")).groupBy(head, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    value = F.round("x", digits) if digits is not None else F.col("x")
    return each.groupBy(head).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("x")))), lambda s: s["x"]).alias("centroid"))


def _alike(span: int, least: float):
    """Of two blocks of heads of one entity the pairs, later to earlier, that are near in time and similar."""

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64()), "entity": pa.array([], pa.string()), "sim": pa.array([], pa.float64())})
        a, b = left.column("id").to_numpy()[:, None], right.column("id").to_numpy()[None, :]
        ta, tb = left.column("at").to_numpy()[:, None], right.column("at").to_numpy()[None, :]
        sim = _matrix(left) @ _matrix(right).T
        i, j = np.nonzero((sim >= least) & (ta - tb <= span) & ((ta > tb) | ((ta == tb) & (a > b))))
        return pa.table({"src": a[i, 0], "dst": b[0, j], "entity": left.column("entity").take(pa.array(i)), "sim": sim[i, j]})

    return alike


def related_heads(heads: DataFrame, entities: DataFrame, days: int = KNOBS.related_days, least: float = KNOBS.related_sim, block: int = 1024) -> DataFrame:
    """heads (head, ts, event_type, centroid) sharing an entity (head, entity) within the days and with
    similar centroids, later to earlier: src, dst, relation, sim, shared (C17).

    Heads meet by entity and stretch of time, in pairs of blocks of about `block`, of which one product keeps
    what is similar: heads that only share an entity make no pairs, however common it is."""
    span = days * 86_400_000_000
    at = epoch_us("ts")
    own = heads.where("centroid is not null and ts is not null").select("head", at.alias("at"), unit(F.col("centroid")).alias("vector"))
    who = entities.select("head", F.col("entity").cast("string").alias("entity")).distinct().join(own, "head").withColumn("stretch", F.floor(F.col("at") / span))
    near = who.select(F.col("head").cast("long").alias("id"), "at", "vector", "entity", "stretch")
    far = who.select(F.col("head").cast("long").alias("id"), "at", "vector", "entity", F.explode(F.array(F.col("stretch") - 1, F.col("stretch"))).alias("stretch"))
    found = _block_pairs(far, near, ["entity", "stretch"], block).applyInArrow(_alike(span, least), "src long, dst long, entity string, sim double")
    met = found.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.array_join(F.sort_array(F.collect_set("entity")), ",").alias("shared"))
    types = heads.select("head", "event_type")
    met = met.join(types.select(F.col("head").alias("src"), F.col("event_type").alias("type_a")), "src").join(types.select(F.col("head").alias("dst"), F.col("event_type").alias("type_b")), "dst")
    relation = F.when((F.col("type_a") == "statement") & (F.col("type_b") != "statement"), "RESPONDS_TO").otherwise("FOLLOWS")
    return met.select("src", "dst", relation.alias("relation"), F.least(F.greatest("sim", F.lit(0.0)), F.lit(1.0)).alias("sim"), "shared")


def head_scalars(members: DataFrame) -> DataFrame:
    """members (head, id, ts, event_type, jurisdiction, topics, tier, confidence) rolled up (C10, C13,
    C14): topics, event_time, event_type and jurisdiction by mode (ties: best tier, then first seen, then the
    value),
    tier, confidence weighted by trust."""
    weight = lookup(TIER_WEIGHT, F.col("tier"))
    total = members.groupBy("head").agg(
        F.min("ts").alias("event_time"), F.min("tier").alias("tier"),
        (F.sum(weight * F.col("confidence")) / F.sum(weight)).alias("confidence"),
    )
    # Sets are combined before they are shuffled, and no longer than there are topics.
    topics = members.select("head", F.explode_outer("topics").alias("topic")).groupBy("head").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    types = members.groupBy("head", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tier", "ts", "id")).alias("seen"))
    types = first_per_key(types, ["head"], F.desc("n"), F.col("seen"), F.col("event_type")).select("head", "event_type")
    places = members.where("jurisdiction is not null").groupBy("head", "jurisdiction").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ts", "id")).alias("seen"))
    places = first_per_key(places, ["head"], F.desc("n"), F.col("seen"), F.col("jurisdiction")).select("head", "jurisdiction")
    return total.join(topics, "head").join(types, "head", "left").join(places, "head", "left")


#: Parts that the spans of a head are dealt to.
SPAN_PARTS = 16


def head_spans(sources: DataFrame, entities: DataFrame, most: int = KNOBS.max_spans) -> DataFrame:
    """head, spans: distinct spans of sources (head, tier, id, span) by tier and id, then of entities
    (head, id, entity, role, topic, span), at most `most` (C15).  Each span is kept once with its first place, and
    only the first `most` of a head are ever together, however many it has."""
    kinds = entities.schema
    none = lambda c: F.lit(None).cast(kinds[c].dataType).alias(c)
    a = sources.select("head", "span", F.struct(F.lit(0).alias("side"), "tier", "id", none("entity"), none("role"), none("topic")).alias("place"))
    b = entities.select("head", "span", F.struct(F.lit(1).alias("side"), F.lit(None).cast(sources.schema["tier"].dataType).alias("tier"), "id", "entity", "role", "topic").alias("place"))
    # The first `most` of each part of a head hold the first `most` of the head, so frequent heads are many tasks.
    parted = a.unionByName(b).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(SPAN_PARTS)))
    parts = parted.count() // 1_000_000 + 1
    first = dealt(parted, ["head", "part"], parts=parts).groupBy("head", "part", "span").agg(F.min("place").alias("place"))
    order = [F.col("place"), F.col("span")]
    near = first.withColumn("rank", F.row_number().over(Window.partitionBy("head", "part").orderBy(*order))).where(F.col("rank") <= most)
    first = dealt(near, ["head"], parts=parts).groupBy("head", "span").agg(F.min("place").alias("place"))
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("head").orderBy(*order))).where(F.col("rank") <= most)
    return best.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "span"))), lambda x: x["span"]).alias("spans"))
