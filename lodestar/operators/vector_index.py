"""An index for the greatest cosine: clusters whose rows the triangle inequality passes over, exact for any data.

Vectors are scaled to length 1, so that the greatest cosine is the least chord, and chords obey the triangle inequality. At most
MAX_CLUSTERS rows, those of the least hash, are the centres; every task deals its rows to the nearest centre and keeps blocks of at
most BLOCK rows of one cluster, with the least and the greatest chord to the centre. Nothing is shuffled to build it, and a cluster that holds a
third of all rows is many blocks.

A search looks at a query's nearest cluster first. The chord to the best row found there bounds the rest: rows of a cluster are no
nearer than the chord to its centre is outside its range of chords, and only the clusters that may hold a nearer row, and of these only
such blocks, are looked at. Where data have no clusters all blocks are, and the result is the same.

The index is kept under a key of its content's name; what has that key is read, not built anew. Null ids, null and zero vectors, and
those with a number that isn't finite have no direction and are left out. Rows of one id are rows of their own; a query is never compared
with rows of its id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.files import exists

MAX_CLUSTERS, BLOCK = 1024, 2048
#: What rounding may add to a chord.
SLACK = 1e-9
INDEX = "cluster int, low double, high double, ids binary, vectors binary"
Batches = Iterator[pa.RecordBatch]


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Ids, vectors scaled to length 1, and places in the batch, of the rows that have a direction."""
    ids, out, places = [], [], []
    for k, (i, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
        cells = x.as_py()
        if i is None or not cells or None in cells:
            continue
        v = np.array(cells, np.float64)
        norm = np.sqrt(v @ v)
        if 0 < norm < np.inf:
            ids.append(i)
            out.append(v / norm)
            places.append(k)
    return np.array(ids, np.int64), np.array(out), places


def chords(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (x @ y.T)))


def _named(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("bigint"), "embedding")


def centres_of(vectors: DataFrame, most: int = MAX_CLUSTERS) -> np.ndarray:
    """The directions of at most `most` rows, about the root of their number, those of the least hash; of equal ones one is left."""
    sound = _named(vectors).where("vec_id IS NOT NULL").where(F.exists("embedding", lambda x: x != 0)).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    k = min(most, ceil(sqrt(sound.count())))
    rows = sound.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(k).collect()
    found = np.array([r["embedding"] for r in rows], np.float64)
    return np.unique(found / np.sqrt((found**2).sum(1, keepdims=True)), axis=0) if len(rows) else np.empty((0, 0))


def key_of(vectors: DataFrame, centres: np.ndarray) -> str:
    """A name for the content of vectors(vec_id, embedding), whatever the order of rows, and the centres."""
    mark = vectors.agg(F.count("*"), F.sum(F.xxhash64("vec_id", "embedding").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "vec_id", "embedding").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(mark)).encode() + centres.tobytes()).hexdigest()[:32]


def build(vectors: DataFrame, path: str, centres: np.ndarray) -> DataFrame:
    """The index of vectors(vec_id, embedding) at path; if it is there already, it is read. A build that didn't end is built again."""
    spark = vectors.sparkSession
    if exists(spark, path):
        return spark.read.schema(INDEX).parquet(path)

    def run(batches: Batches) -> Batches:
        held: dict[int, list[tuple]] = {}

        def block(c: int) -> pa.RecordBatch:
            ids, x, d = (np.concatenate(p) for p in zip(*held.pop(c), strict=True))
            return pa.record_batch([pa.array([c], pa.int32()), pa.array([d.min()]), pa.array([d.max()]), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["cluster", "low", "high", "ids", "vectors"])

        for batch in batches:
            ids, x, _ = _unit(batch)
            if not len(ids):
                continue
            far = chords(x, centres)
            near = far.argmin(1)
            for c in np.unique(near).tolist():
                mine = np.flatnonzero(near == c)
                for a in range(0, len(mine), BLOCK):
                    some = mine[a : a + BLOCK]
                    held.setdefault(c, []).append((ids[some], x[some], far[some, c]))
                    if sum(len(p[0]) for p in held[c]) >= BLOCK:
                        yield block(c)
        for c in list(held):
            yield block(c)

    _named(vectors).mapInArrow(run, INDEX).write.mode("overwrite").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _blocks(queries: DataFrame, centres: np.ndarray, limits: np.ndarray | None, schema: str) -> DataFrame:
    """Queries dealt to clusters, as blocks: to the nearest without limits, else to all others that may hold a row nearer than `best`."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, x, places = _unit(batch)
            if not len(ids):
                continue
            far = chords(x, centres)
            near = far.argmin(1)
            best = np.full(len(ids), 2.0)
            if limits is None:
                wanted = np.zeros_like(far, bool)
                wanted[np.arange(len(ids)), near] = True
            else:
                best = np.array(batch.column(2).to_pylist(), np.float64)[places]
                gap = np.maximum(limits[:, 0] - far, far - limits[:, 1])
                wanted = gap < best[:, None] + SLACK
                wanted[np.arange(len(ids)), near] = False
            for c in np.flatnonzero(wanted.any(0)).tolist():
                some = np.flatnonzero(wanted[:, c])
                for a in range(0, len(some), BLOCK):
                    s = some[a : a + BLOCK]
                    cells = [ids[s].tobytes(), x[s].tobytes(), far[s, c].tobytes(), best[s].tobytes()]
                    yield pa.record_batch([pa.array([c], pa.int32()), *(pa.array([b], pa.binary()) for b in cells)], names=["cluster", "q_ids", "q", "far", "best"])

    return queries.mapInArrow(run, schema)


def _compared(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(vec_id, chord, compared): of each query and block the least chord, and how many rows it was compared with."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for low, high, c_ids, c, q_ids, q, far, best in zip(*(batch.column(n) for n in ("low", "high", "ids", "vectors", "q_ids", "q", "far", "best")), strict=True):
                ids, names = np.frombuffer(q_ids.as_buffer(), np.int64), np.frombuffer(c_ids.as_buffer(), np.int64)
                x, y = np.frombuffer(q.as_buffer()).reshape(len(ids), -1), np.frombuffer(c.as_buffer()).reshape(len(names), -1)
                d, b = np.frombuffer(far.as_buffer()), np.frombuffer(best.as_buffer())
                some = np.flatnonzero(np.maximum(low.as_py() - d, d - high.as_py()) < b + SLACK)
                found = np.where(ids[some, None] == names, np.inf, chords(x[some], y)).min(1) if len(some) else np.empty(0)
                yield pa.record_batch([pa.array(ids[some]), pa.array(found), pa.array(np.full(len(some), len(names), np.int64))], names=["vec_id", "chord", "compared"])

    return asked.join(index, "cluster").mapInArrow(run, "vec_id bigint, chord double, compared bigint")


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, nn_sim, compared) of queries(vec_id, embedding) of distinct ids: the greatest cosine to a row of another id, null where there is none."""
    schema = "cluster int, q_ids binary, q binary, far binary, best binary"
    ranges = {r["cluster"]: (r["low"], r["high"]) for r in index.groupBy("cluster").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # MAX_CLUSTERS rows
    limits = np.array([ranges.get(c, (np.inf, np.inf)) for c in range(len(centres))]).reshape(-1, 2)
    named = _named(queries)
    least = lambda df: df.groupBy("vec_id").agg(F.min("chord").alias("chord"), F.sum("compared").alias("compared"))
    first = least(_compared(_blocks(named, centres, None, schema), index))
    left = named.join(first.select("vec_id", "chord"), "vec_id", "left").select("vec_id", "embedding", F.least(F.coalesce("chord", F.lit(2.0)), F.lit(2.0)).alias("best"))
    found = least(first.unionByName(_compared(_blocks(left, centres, limits, schema), index)))
    chord = F.when(F.col("chord") < float("inf"), F.col("chord"))
    return found.select("vec_id", (1 - chord * chord / 2).alias("nn_sim"), "compared")
