"""Shared storage and lineage cuts for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-lodestar-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only where that is unset and Spark is a single process (tests), one of our own; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    return (path or _own_dir()).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read, not a recomputation, and rows that depended on
    task order are fixed from then on.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
            if "/lodestar/" not in folder:
                raise ValueError(f"not a table of this package: {folder}")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have, one for each wanted one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        new, k = f"_{name}", 0
        while new.lower() in taken:
            k += 1
            new = f"_{name}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


BITMAP_BITS = 25


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bit for every value of a long column by its low BITMAP_BITS bits, as 64-bit words.

    It has 4 MB at any input size. Values that aren't there may seem to be; those that are never seem not to be.
    """
    place = F.col(column).bitwiseAND((1 << BITMAP_BITS) - 1)
    words = df.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.toArrow()  # at most 2^(BITMAP_BITS - 6) rows
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit values may be in it."""
    place = values & np.uint64((1 << BITMAP_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


#: What Spark's xxhash64 starts with, and what it goes on with after an integer 1.
_SEEDS = (42, xxhash.xxh64_intdigest(b"\1\0\0\0", 42))


def text_id(data: bytes) -> bytes:
    """128 bits that stand for a text: two XXH64 of its bytes, of different seeds."""
    return b"".join(xxhash.xxh64_digest(data, seed) for seed in _SEEDS)


def text_id_column(text: Column) -> Column:
    """What text_id gives, worked out by Spark."""
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit(1), text))]))


def mark_of_id(column: str) -> Column:
    """The low 56 bits of the first half of a text_id, for bitmaps; those of F.xxhash64(text) are the same."""
    return F.conv(F.hex(F.substring(column, 2, 7)), 16, 10).cast("long")


def components(links: DataFrame) -> DataFrame:
    """(id, root): connected components of links (a, b) of long ids, root the least id. Ids without links are absent.

    Alternating large and small stars: each round points the larger neighbours, then the smaller ones, of every id at the
    least of them, until nothing changes. Minima are aggregated before they are joined, so that hot ids split.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    last = mark(edges)
    while last[0]:
        both = edges.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(edges.select(F.col("u").alias("x"), F.col("v").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        large = materialize(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct("v", F.col("m").alias("u")))).alias("e")).select("e.*")
        edges = materialize(small.where("u <> v").distinct(), "edges")
        now = mark(edges)
        if now == last:
            break
        last = now
    roots = edges.select(F.col("v").alias("id"), F.col("u").alias("root"))
    return roots.unionByName(edges.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct())
