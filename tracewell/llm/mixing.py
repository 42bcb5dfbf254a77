"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas, then a
seeded choice of documents.

Sources overlap where they hold the same text.  The set of sources that hold a text is its membership
pattern; only patterns and their cells (the rows of one pattern in one source), a few numbers each, reach
the driver, never texts or documents, and all of them are routed.  Their tables are broadcast up to
`most_broadcast` rows and joined by shuffles beyond.  The flow routes words from patterns through cells to source
quotas: a cell gives at most `epochs` times its words, and each further use of a pattern's texts, by
whichever source, costs more, so texts that one source can spare are not repeated by another.
Documents are then chosen in the order of a seeded digest: whole buckets by their sums, and only the
bucket in which a cell's flow ends by a running sum.

Cases: a null text or one without words has size 0 and takes 0; a null source is a source of its own,
after all others; repeated rows are rows of their own (equal digests are ordered by doc_id and
position does not matter, since ties share the same size or differ in doc_id); an empty table gives
an empty result; further columns are ignored, and those of `keep` give way to result columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stash

# Weights of the sources in order of code points, repeating; the share of all words to
# take; the most uses of one document.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def quotas(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], share: float, epochs: int) -> list[float]:
    """Targets in the order of sizes: share * all words by weight, none above epochs * its size, the
    excess shared again by weight among the others until none is above."""
    total, caps = share * sum(n for _, n in sizes), [epochs * float(n) for _, n in sizes]
    weigh = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = total - sum(caps[i] for i in full)
        open_weight = sum(w for i, w in enumerate(weigh) if i not in full)
        out = [caps[i] if i in full else left * weigh[i] / open_weight for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in full and out[i] > caps[i]}
        if not over:
            return out
        full |= over


class _Network:
    """Arcs with room; `push` adds as much flow as fits, level by level of the shortest paths."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        """Number of the new arc; the one after it leads back."""
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def push(self, first: int, last: int) -> None:
        while True:
            level = [-1] * len(self.out)
            level[first], queue = 0, [first]
            for a in queue:
                for e in self.out[a]:
                    if self.room[e] and level[self.to[e]] < 0:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if level[last] < 0:
                return
            tried = [0] * len(self.out)
            trail: list[int] = []
            at = first
            while True:
                if at == last:
                    flow = min(self.room[e] for e in trail)
                    for e in trail:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    at, trail = first, []
                    continue
                arcs = self.out[at]
                while tried[at] < len(arcs):
                    e = arcs[tried[at]]
                    if self.room[e] and level[self.to[e]] == level[at] + 1:
                        break
                    tried[at] += 1
                else:
                    if at == first:
                        break
                    at = self.to[trail.pop() ^ 1]
                    tried[at] += 1
                    continue
                trail.append(e)
                at = self.to[e]


def min_cost_flow(patterns: Sequence[tuple[int, dict[int, int]]], quota: Sequence[int], epochs: int) -> dict[tuple[int, int], int]:
    """Words from pattern p to source s, {(p, s): words}, as many as quotas and cells allow, at least
    cost.  patterns: (words of its texts, {source: words of its rows there}).  The k-th use of a
    pattern's texts costs k a word.  All costs lie on the arcs into patterns, so what is routed at
    lower costs never has to be taken back there: arcs are added by cost, and flow is pushed until no
    more fits, which is least cost for every amount."""
    first, last = len(patterns) + len(quota), len(patterns) + len(quota) + 1
    net = _Network(last + 1)
    cells = {(p, s): net.arc(p, len(patterns) + s, epochs * n) for p, (_, own) in enumerate(patterns) for s, n in own.items()}
    for s, q in enumerate(quota):
        net.arc(len(patterns) + s, last, q)
    left = {p: epochs * sum(own.values()) for p, (words, own) in enumerate(patterns) if words}
    while left:
        for p in left:
            room = min(left[p], patterns[p][0])
            net.arc(first, p, room)
            left[p] -= room
        net.push(first, last)
        left = {p: n for p, n in left.items() if n}
    return {k: net.room[e ^ 1] for k, e in cells.items() if net.room[e ^ 1]}


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 7, most_broadcast: int = 100_000, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken,
    and the columns in keep.  taken counts words with repeats: a whole number of uses, but for the one
    document in which a cell's flow ends, which gives just the words that are missing, so each source's
    words add up to its target, rounded."""
    keep = [c for c in keep if c not in ("doc_id", "source", "size", "source_size", "target", "taken")]
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACE), lambda w: w != F.lit(""))
    size = F.size(words).cast("long")
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    columns = [F.col("doc_id").cast("long"), "source", size.alias("size"), draw.alias("draw"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")]
    sized = stash(docs.select(*columns), "mix-sizes")
    spark = sized.sparkSession
    sources = [(r.source, r.n) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    sources.sort(key=lambda x: (x[0] is None, x[0] or ""))
    target = quotas(sources, weights, share, epochs) if sum(n for _, n in sources) else [0.0] * len(sources)

    def small(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= most_broadcast else rows

    per_source = small(spark.createDataFrame([(s, i, n, float(t)) for i, ((s, n), t) in enumerate(zip(sources, target))], "name string, sid int, source_size long, target double"), len(sources))

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(per_source.select("name", "sid"), rows["source"].eqNullSafe(F.col("name"))).drop("name")

    # Texts that several sources hold.
    texts = numbered(sized).where("size > 0").groupBy("digest").agg(F.sort_array(F.collect_set("sid")).alias("sids"), F.first("size").alias("size"))
    texts = texts.withColumn("pattern", F.when(F.size("sids") > 1, F.array_join("sids", ",")))
    pooled = stash(texts.where("pattern is not null").select("digest", "pattern", "size"), "mix-pooled")

    def placed(rows: DataFrame) -> DataFrame:
        found = numbered(rows).join(pooled.select("digest", "pattern"), "digest", "left").drop("digest")
        return found.withColumn("pattern", F.coalesce("pattern", F.col("sid").cast("string")))

    own = placed(sized)
    cells = own.groupBy("pattern", "sid").agg(F.sum("size").alias("n")).collect()
    held = {r.pattern: r.n for r in pooled.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    by: dict[str, dict[int, int]] = {}
    for r in sorted(cells, key=lambda r: (r.pattern, r.sid)):
        by.setdefault(r.pattern, {})[r.sid] = r.n
    names = list(by)
    flow = min_cost_flow([(held.get(p, sum(by[p].values())), by[p]) for p in names], [round(t) for t in target], epochs)
    use = [(p, s, flow.get((i, s), 0) // max(n, 1), flow.get((i, s), 0) % max(n, 1)) for i, p in enumerate(names) for s, n in by[p].items()]
    # A row per cell.
    uses = small(spark.createDataFrame(use, "pattern string, sid int, uses long, rest long"), len(use))
    cell = ["pattern", "sid"]
    # Running sums over 4096 buckets a cell, then over the documents of one bucket of each.
    out = placed(docs.select(*columns, F.struct(*keep).alias("kept"))) if keep else own
    out = out.withColumn("bucket", F.substring("draw", 1, 3)).join(uses, cell)
    sums = own.groupBy(*cell, F.substring("draw", 1, 3).alias("bucket")).agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("before", before).join(uses, cell).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))).select(*cell, F.col("bucket").alias("edge"), "before")
    out = out.join(small(edges, len(use)), cell, "left")
    within = Window.partitionBy(*cell).orderBy("draw", F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = out.where(F.col("bucket") == F.col("edge")).withColumn("room", F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0)))
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least("size", "room"))).drop("room")
    outside = out.where(F.col("edge").isNull() | (F.col("bucket") != F.col("edge"))).withColumn("more", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(F.lit(0)))
    done = inside.unionByName(outside).withColumn("taken", (F.col("uses") * F.col("size") + F.col("more")).cast("long"))
    done = done.join(per_source.drop("name"), "sid")
    return done.select("doc_id", "source", *[F.col(f"kept.`{c}`") for c in keep], "size", "source_size", "target", "taken")
