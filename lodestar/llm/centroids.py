"""Centroid clustering by partial-distance search over integer vectors (operator 12).

Kept are vectors of exactly `dims` components, none null or not finite; a component x becomes floor(scale * x), x as double.
The first centroids are the kept vectors with the smallest sha256 of "<seed>:<vec_id>", in that order. A round assigns every
vector to the nearest centroid (squared distance; ties: the smaller number) and replaces every centroid that has vectors by
their componentwise floor(sum / count), exactly; others stay. After the rounds vectors are assigned once more.

The search: dimensions are put in order of falling variance and squared differences are added up STEP dimensions at a time.
A centroid is abandoned for a vector as soon as its partial distance is above the best so far; those that are left finish all
dimensions. Each task takes its own rows batch by batch and hands on one row for each centroid, so a round shuffles k rows a
task, whichever vectors are common; the driver gets k centroids.

Defined cases: vectors with a component of 2^21 or more (or -2^21 or less) are left out like infinite ones, as their squared
distances don't fit a long. A null vec_id comes last among the candidates for centroids and is kept; rows with one vec_id are
vectors of their own, in order of their components. With fewer than k kept vectors there are as many centroids; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import discard, materialize

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, 1
STEP = 8
#: Components below it in size keep 64 squared differences of 64 * x within a long.
LIMIT = 1 << 21

Batches = Iterator[pa.RecordBatch]


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as arrays of long."""
    sound = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT, F.lit(False)))
    kept = vectors.select("vec_id", "embedding").where(F.size("embedding") == dims).where(sound)
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("v"))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The number of the nearest centroid of every row, its squared distance, and how many squared differences were added up."""
    x, c = x[:, order], centroids[:, order]
    first = x - c[0]
    best, label, work = np.einsum("ij,ij->i", first, first), np.zeros(len(x), np.int32), first.size
    for j in range(1, len(c)):
        alive, part = np.arange(len(x)), np.zeros(len(x), np.int64)
        for a in range(0, x.shape[1], STEP):
            diff = x[alive, a : a + STEP] - c[j, a : a + STEP]
            work += diff.size
            part += np.einsum("ij,ij->i", diff, diff)
            left = part <= best[alive]
            alive, part = alive[left], part[left]
            if not len(alive):
                break
        won = part < best[alive]
        best[alive[won]], label[alive[won]] = part[won], j
    return label, best, work


def _totals(batches: Batches, dims: int, groups: int, label: Callable[[np.ndarray], np.ndarray]) -> Batches:
    """One row for each group of a task: group, count, and the sums of components and of their squares."""
    n, total, square = np.zeros(groups, np.int64), np.zeros((groups, dims), np.int64), np.zeros((groups, dims))
    for batch in batches:
        if batch.num_rows:
            x = rows_of(batch.column(0), dims)
            which = label(x)
            n += np.bincount(which, minlength=groups)
            for g in np.unique(which):
                mine = x[which == g]
                total[g] += mine.sum(0)
                square[g] += np.square(mine, dtype=float).sum(0)
    found = np.flatnonzero(n)
    yield pa.record_batch([pa.array(found), pa.array(n[found]), pa.array(list(total[found]), pa.list_(pa.int64())), pa.array(list(square[found]), pa.list_(pa.float64()))], names=["g", "n", "total", "square"])


def totals(kept: DataFrame, dims: int, groups: int, label: Callable[[np.ndarray], np.ndarray]) -> list:
    """(group, dimension, count, exact sum, sum of squares), at most groups * dims rows."""
    parts = kept.select("v").mapInArrow(lambda b: _totals(b, dims, groups, label), "g bigint, n bigint, total array<bigint>, square array<double>")
    each = parts.select("g", "n", F.posexplode(F.arrays_zip("total", "square")).alias("d", "x"))
    return each.groupBy("g", "d").agg(F.sum("n").alias("n"), F.sum(F.col("x.total").cast("decimal(38,0)")).alias("total"), F.sum("x.square").alias("square")).collect()


def by_variance(kept: DataFrame, dims: int) -> np.ndarray:
    """Dimensions, that with the largest variance first."""
    spread = np.zeros(dims)
    for r in totals(kept, dims, 1, lambda x: np.zeros(len(x), np.int64)):
        spread[r["d"]] = r["square"] / r["n"] - (float(r["total"]) / r["n"]) ** 2
    return np.argsort(-spread, kind="stable")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    kept = materialize(integer_vectors(vectors, dims, scale), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = kept.orderBy(rank.asc_nulls_last(), "v").select("v").limit(k).collect()
    centroids = np.array([r["v"] for r in chosen], np.int64).reshape(len(chosen), dims)
    assigned = "vec_id bigint, cluster int, distance bigint"
    if not len(chosen):
        order = np.arange(dims)
    else:
        order = by_variance(kept, dims)
        for _ in range(rounds):
            now = centroids.copy()
            for r in totals(kept, dims, len(now), lambda x, c=centroids: nearest(x, c, order)[0]):
                now[r["g"], r["d"]] = int(r["total"]) // r["n"]
            centroids = now

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            if batch.num_rows:
                label, best, _ = nearest(rows_of(batch.column(1), dims), centroids, order)
                yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(label), pa.array(best)], names=["vec_id", "cluster", "distance"])

    done = materialize(kept.mapInArrow(assign, assigned), "assigned")
    discard(kept)
    exact = F.col("distance").cast("decimal(38,0)")
    inertia = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(exact).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(j, inertia.get(j, 0), sum(inertia.values()), digest[j]) for j in range(len(centroids))]
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
