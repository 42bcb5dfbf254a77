"""Hard-negative mining with Fagin's threshold algorithm.

Rows are dealt to blocks of about `block` rows, ordered by label, so that few blocks hold a label's rows;
anchors are dealt to chunks.  A task gets one block and one chunk.  For the block it sorts one candidate list
per dimension.  For an anchor it reads these lists from the end that the sign of the anchor's component
favours, all to the same depth, doubling the depth each time; it looks up each candidate met for the first
time and computes its integer score at random access.  No row unseen scores above the threshold, the sum of
the anchor's components times the values at the depth reached.  Reading stops once, for every window of
scores asked for, the threshold lies strictly below the kth score found in it (rows that tie with that may
have a smaller vec_id) or below the window itself.  The best k of a block go on, and a ranking over all blocks
takes the best k of those.

Two passes: the first finds each anchor's positives among blocks that hold its label, with one window
without limits; in the second each positive is a window for rows of other labels.

Cases: rows without vec_id, label or vector, and vectors with a component that is null, not finite or 2**18
and more in magnitude, take no part; components that a shorter vector lacks count as zero; rows equal in
vec_id, label and vector are one row, while a vec_id with two vectors is two rows, which are each other's
candidates; an anchor without another row of its label gives no rows, as does a positive with a negative
score, whose window is empty; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, stash
from .vectors import matrix, usable, whole_numbers


class Lists:
    """Sorted candidate lists of a block of vectors, one per dimension."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells
        self.rising = np.ascontiguousarray(np.argsort(cells, axis=0, kind="stable").T)
        self.falling = np.ascontiguousarray(self.rising[:, ::-1])
        most = int(np.abs(cells).max(initial=0))
        # Products of floats are exact up to 2**53.
        self.exact = cells.astype(np.float64) if most * most * cells.shape[1] < 1 << 52 else cells
        self.most = most

    def best(self, anchor: np.ndarray, wanted: np.ndarray, lows: np.ndarray, highs: np.ndarray, ids: np.ndarray, k: int, depth: int = 16) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window lows[i] <= score <= highs[i], the first k rows among `wanted` by score, then by
        smaller id, and their scores."""
        n = len(self.cells)
        use = np.flatnonzero(anchor)
        if not len(use):
            use = np.arange(1)
        part, rises = anchor[use], (anchor[use] < 0)[:, None]
        fast = self.exact.dtype == np.float64 and int(np.abs(anchor).max(initial=0)) <= max(self.most, 1)
        vector = anchor.astype(self.exact.dtype) if fast else anchor
        seen = np.zeros(n, dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in lows]
        open_ = list(range(len(lows)))
        lo = 0
        while open_ and lo < n:
            hi = min(n, max(depth, 2 * lo))
            met = np.where(rises, self.rising[use, lo:hi], self.falling[use, lo:hi])
            before = seen.copy()
            seen[met.ravel()] = True
            new = np.flatnonzero(seen & ~before & wanted)
            scores = ((self.exact if fast else self.cells)[new] @ vector).astype(np.int64)
            threshold = int(part @ self.cells[met[:, -1], use])
            for i in list(open_):
                fits = np.flatnonzero((scores >= lows[i]) & (scores <= highs[i]))
                if len(fits):
                    row, score = np.concatenate([found[i][0], new[fits]]), np.concatenate([found[i][1], scores[fits]])
                    if len(row) > k:
                        first = np.lexsort((ids[row], -score))[:k]
                        row, score = row[first], score[first]
                    found[i] = row, score
                if threshold < lows[i] or (len(found[i][1]) >= k and threshold < int(found[i][1].min())):
                    open_.remove(i)
            lo = hi
        return found


def _block(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Lists]:
    ids, labels, keys = (rows.column(c).to_numpy() for c in ("vec_id", "label", "key"))
    return ids, labels, keys, Lists(matrix(rows.column("q"), width))


def _positives(rows: pa.Table, anchors: pa.Table, width: int, k: int) -> pa.Table:
    out = []
    if rows.num_rows and anchors.num_rows:
        ids, labels, keys, lists = _block(rows, width)
        limit = np.iinfo(np.int64).max
        for key, label, q in zip(anchors.column("key").to_pylist(), anchors.column("label").to_pylist(), matrix(anchors.column("q"), width)):
            (row, score), = lists.best(q, (labels == label) & (keys != key), np.array([-limit]), np.array([limit]), ids, k)
            out += zip([key] * len(row), ids[row].tolist(), score.tolist())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["key", "positive_id", "positive_score"])


def _negatives(rows: pa.Table, anchors: pa.Table, width: int, k: int, low: int) -> pa.Table:
    out = []
    if rows.num_rows and anchors.num_rows:
        ids, labels, _, lists = _block(rows, width)
        for key, label, q, tops in zip(anchors.column("key").to_pylist(), anchors.column("label").to_pylist(), matrix(anchors.column("q"), width), anchors.column("tops").to_pylist()):
            tops = sorted({t for t in tops if t >= 0})
            found = lists.best(q, labels != label, np.array([-(-low * t // 100) for t in tops], dtype=np.int64), np.array(tops, dtype=np.int64), ids, k)
            for top, (row, score) in zip(tops, found):
                out += zip([key] * len(row), [top] * len(row), ids[row].tolist(), score.tolist())
    return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["key", "positive_score", "negative_id", "negative_score"])


def _searched(rows: DataFrame, anchors: DataFrame, pairs: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run on each pair (block, chunk) of rows and anchors."""
    left, right = rows.join(pairs, "block"), anchors.join(pairs, "chunk")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(run, schema)


def _ranked(found: DataFrame, group: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, block: int = 4096, blocks_a_chunk: int = 64) -> DataFrame:
    """For each anchor, a row of rows (vec_id, label, embedding) whose vec_id is divisible by `every`, and each of
    its `positives` best rows of the same label, the `negatives` best rows of other labels with low *
    positive_score <= 100 * negative_score <= 100 * positive_score: anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.  Best is the largest inner product of integer vectors, then
    the smallest vec_id.  Where vec_id is divisible by 7 the label first becomes (label + 1) % 10."""
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    ours = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole_numbers(F.col("embedding")).alias("q"))
    ours = stash(ours.withColumn("key", F.xxhash64("vec_id", "label", "q")), "vectors")
    n, width = ours.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    dealt_to = max(1, -(-n // block))
    dealt = ours.repartitionByRange(dealt_to, "label", F.xxhash64("vec_id"), "key").withColumn("block", F.spark_partition_id())
    # Repeated rows stand in one block, so nothing is moved to find them.
    dealt = stash(dealt.dropDuplicates(["block", "key", "vec_id", "label", "q"]).withColumn("chunk", (F.col("block") / blocks_a_chunk).cast("int")), "blocks")
    dealt, anchors = dealt.drop("chunk"), dealt.where(F.col("vec_id") % every == 0).drop("block")
    # Blocks and chunks that share a label, and later all blocks and chunks: the anchors are a stated query set.
    chunk = anchors.select("chunk", "label").distinct()
    shared = dealt.select("block", "label").distinct().join(chunk, "label").select("block", "chunk").distinct()
    found = _searched(dealt, anchors, shared, partial(_positives, width=width or 0, k=positives), "key long, positive_id long, positive_score long")
    best = stash(_ranked(found, ["key"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    tops = best.groupBy("key").agg(F.collect_list("positive_score").alias("tops"))
    asked = stash(anchors.join(tops, "key"), "anchors")
    every_pair = dealt.select("block").distinct().select("block", F.explode(F.sequence(F.lit(0), (F.lit(dealt_to - 1) / blocks_a_chunk).cast("int"))).alias("chunk"))
    found = _searched(dealt, asked, every_pair, partial(_negatives, width=width or 0, k=negatives, low=low), "key long, positive_score long, negative_id long, negative_score long")
    worst = stash(_ranked(found, ["key", "positive_score"], "negative_score", "negative_id", negatives), "negatives")
    release(ours)
    named = best.join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key").join(worst, ["key", "positive_score"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
