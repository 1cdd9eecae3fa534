"""Order statistics and row numbers of frames of any size: nothing is put in one order by one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.storage import written

STEPS = 4096


def largest(df: DataFrame, column: str, ranks: Sequence[int]) -> list[float | None]:
    """For each rank k the k-th largest value of a number column (nulls and NaN left out), None where there are fewer.

    Each round counts the values of the intervals that hold a rank in STEPS parts, and goes on with the part that holds it: a round is
    one aggregation of at most STEPS rows for each interval, and a part with one distinct value ends it.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    open_ = {k: (low, high, k) for k in ranks if 1 <= k <= n}
    while open_:
        spans = sorted({(a, b) for a, b, _ in open_.values()})
        for k, (a, b, _) in list(open_.items()):
            if a == b:
                found[k] = a
                del open_[k]
        spans = [s for s in spans if s[0] < s[1]]
        if not open_:
            break
        v, which = F.col("v"), F.lit(None).cast("int")
        for i, (a, b) in enumerate(spans):
            which = F.when((v >= a) & (v <= b), i).otherwise(which)
        part = F.lit(None).cast("long")
        for i, (a, b) in enumerate(spans):
            part = F.when(F.col("span") == i, F.floor((v - F.lit(a)) / F.lit(b - a) * STEPS)).otherwise(part)
        inside = values.withColumn("span", which).where("span IS NOT NULL").withColumn("part", part)
        parts = inside.groupBy("span", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for k, (a, b, rank) in open_.items():
            mine = sorted((r for r in parts if spans[r["span"]] == (a, b)), key=lambda r: -r["high"])
            for r in mine:
                if rank <= r["n"]:
                    open_[k] = (r["low"], r["high"], rank)
                    break
                rank -= r["n"]
    return [found.get(k) for k in ranks]


def percentiles(df: DataFrame, group: str, column: str, shares: Sequence[float]) -> DataFrame:
    """(group, p0, p1, ...): the nearest-rank percentiles of each group, the value at place max(1, ceil(share * n)); nulls and NaN left out.

    `largest` for all groups at once: the open intervals are a table with a row for each group and share, and a round counts the rows of each in
    STEPS parts. No buffer holds a group's values, and no window more than STEPS rows.
    """
    values = df.select(F.col(group).alias("_g"), F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    ends = values.groupBy("_g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("w", wanted)
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.col("w.share") - 1e-9))
    open_, closed = written(ends.select("_g", "w.i", "low", "high", rank.alias("rank")), "ranks"), []
    while True:
        closed.append(open_.where("low = high").select("_g", "i", F.col("low").alias("v")))
        open_ = open_.where("low < high")
        if open_.isEmpty():
            break
        o = open_.select(F.col("_g").alias("_h"), "i", "low", "high", "rank")
        inside = values.join(o, F.col("_g").eqNullSafe(F.col("_h")) & F.col("v").between(F.col("low"), F.col("high")))
        part = F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * STEPS)  # halves, as a difference may be infinite
        parts = inside.groupBy("_h", "i", "rank", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("_h", "i").orderBy("part"))
        held = parts.withColumn("_upto", upto).where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("n") < F.col("rank")))
        open_ = written(held.select(F.col("_h").alias("_g"), "i", "low", "high", (F.col("rank") - F.col("_upto") + F.col("n")).alias("rank")), "ranks")
    found = closed[0]
    for c in closed[1:]:
        found = found.unionByName(c)
    return found.groupBy(F.col("_g").alias(group)).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"p{i}") for i in range(len(shares))])


def coverage_grid(df: DataFrame, column: str, levels: Sequence[float]) -> list[float]:
    """Falling thresholds that let the given shares of rows through: for each level the k-th largest value, k = max(1, ceil(level * n)); ties once."""
    n = df.where(F.col(column).isNotNull()).count()
    found = largest(df, column, [max(1, ceil(x * n - 1e-9)) for x in levels])
    return sorted({x for x in found if x is not None}, reverse=True)


def floor_index(df: DataFrame, column: str, share: float) -> float | None:
    """The value at place min(n - 1, floor(share * n)) of the ascending values."""
    n = df.where(F.col(column).isNotNull()).count()
    return largest(df, column, [n - min(n - 1, int(share * n))])[0] if n else None


def numbered(df: DataFrame, order: str, name: str = "place", block: int = 1 << 16) -> DataFrame:
    """df with a gapless number from 0 by a long column without repeats: rows are counted in blocks of the column's range, then numbered within them."""
    at = F.floor(F.col(order) / block)
    counts = df.groupBy(at.alias("_block")).agg(F.count("*").alias("_n"))
    before = counts.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_before"))  # a row for each block
    place = F.row_number().over(Window.partitionBy("_block").orderBy(order)) - 1 + F.col("_before")
    return df.withColumn("_block", at).join(before, "_block").withColumn(name, place).drop("_block", "_before")


def fold(key: Column, k: int = 5) -> Column:
    """The fold of a numbered row."""
    return F.pmod(key, F.lit(k)).cast("int")
