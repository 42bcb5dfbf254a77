"""Centroid clustering with a bisector tournament.

Between two centroids a and b, a vector v is nearer to b exactly if 2 * (b - a) . v > |b|^2 - |a|^2.  The
normals 2 * (b - a) and these thresholds are integers and are computed once a round for all pairs of
centroids.  Centroids then play in the order of their numbers: the winner so far meets the next one, one
linear sign test each, so k - 1 tests leave the nearest; a test of zero keeps the smaller number.  Distances
are computed for the winner alone, exactly.

Each round is one pass over a written table of integer vectors; tasks return sums and counts per centroid,
which Spark adds up.  The driver holds the centroids only, k * dims integers.

Cases: vectors that are null, not of `dims` components, or hold a component that is null, not finite or
2**18 and more in magnitude take no part; repeated rows count each; rows without a vec_id are clustered but
start no centroid; with fewer than k vectors each starts one; equal hashes (a vec_id that occurs twice) go by
the vector; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stash
from .vectors import matrix, usable, whole_numbers

#: Vectors of one tournament.
BLOCK = 4096


def bisectors(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """normals[a, b] and thresholds[a, b] of all pairs of centroids."""
    square = (centroids * centroids).sum(axis=1)
    return 2 * (centroids[None, :, :] - centroids[:, None, :]), square[None, :] - square[:, None]


def tournament(vectors: np.ndarray, normals: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each vector, the smaller of equally near ones."""
    best = np.zeros(len(vectors), dtype=np.int64)
    for other in range(1, len(thresholds)):
        side = np.einsum("vd,vd->v", normals[best, other], vectors) - thresholds[best, other]
        best[side > 0] = other
    return best


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    for lo in range(0, batch.num_rows, BLOCK):
        yield lo, matrix(batch.column("q").slice(lo, BLOCK), dims)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, dims = centroids.shape
    normals, thresholds = bisectors(centroids)
    total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
    for batch in batches:
        for _, v in _blocks(batch, dims):
            best = tournament(v, normals, thresholds)
            count += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            held, first = np.unique(best[order], return_index=True)
            total[held] += np.add.reduceat(v[order], first)
    held = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "total"])


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    normals, thresholds = bisectors(centroids)
    for batch in batches:
        for lo, v in _blocks(batch, centroids.shape[1]):
            best = tournament(v, normals, thresholds)
            apart = v - centroids[best]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").slice(lo, len(v)), pa.array(best.astype(np.int32)), pa.array((apart * apart).sum(axis=1))], ["vec_id", "cluster", "distance"])


def cluster_vectors(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: str = "2") -> DataFrame:
    """One row per vector of rows (vec_id, embedding) that takes part: vec_id, cluster, distance (squared, to its
    centroid), cluster_inertia, inertia, centroid_sha256, and centroid (its components).

    Centroids start as the k vectors with the smallest sha256 of `<seed>:<vec_id>`.  Each round assigns all
    vectors and replaces every centroid that has any by floor(sum / count) of each component."""
    spark = rows.sparkSession
    ours = rows.where((F.size("embedding") == dims) & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("q"))
    ours = stash(ours, "vectors")
    drawn = ours.where(F.col("vec_id").isNotNull()).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("draw"), "q")
    centroids = np.array([r.q for r in drawn.orderBy("draw", "q").limit(k).collect()], dtype=np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    for _ in range(rounds):
        parts = ours.mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, total array<long>")
        added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))
        for r in added.collect():
            centroids[r.cluster] = np.floor_divide(np.array(r.total, dtype=np.int64), r.n)
    found = stash(ours.mapInArrow(partial(_assigned, centroids=centroids), "vec_id long, cluster int, distance long"), "assigned")
    release(ours)
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    named = [(i, inertia.get(i, 0), sum(inertia.values()), digest[i], c) for i, c in enumerate(centroids.tolist())]
    # k rows.
    told = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")
