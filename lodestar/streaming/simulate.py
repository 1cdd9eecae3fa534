"""Calibration of the deferral share that trips, and replays of bursts, as many seeded streams in parallel.

Labelled rows are a table (place, deferred, correct) numbered from 0. What a stream draws are places, from hashes of seed, stream
and step; they are joined with the table, so it may have any size. A stream has a bounded length and is one group.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.streaming.drift import Limits, Machine


def draw(n: int, *seed: Column | int) -> Column:
    """A place from 0 to n - 1 that depends on the seed alone."""
    return F.pmod(F.xxhash64(*[F.lit(s) if isinstance(s, int) else s for s in seed]), F.lit(n))


def steps(spark: SparkSession, n_streams: int, length: int) -> DataFrame:
    """(stream, step) of n_streams streams of `length` steps."""
    return spark.range(n_streams).select(F.col("id").alias("stream"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("step"))


def blocks(spark: SparkSession, n: int, n_streams: int, length: int, block: int, seed: int, kind: int) -> DataFrame:
    """(stream, step, place): runs of `block` places from random ones on, going round at the end."""
    start = draw(n, seed, kind, F.col("stream"), F.floor(F.col("step") / block))
    return steps(spark, n_streams, length).withColumn("place", F.pmod(start + F.col("step") % block, F.lit(n)))


def first_trips(flags: np.ndarray, window: int, least: int) -> np.ndarray:
    """For j = 1..window, after how many requests the last `window` first hold a share of j/window or more; 0 for never."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    end = np.arange(1, len(flags) + 1)
    size = np.minimum(end, window)
    share = (sums[end] - sums[end - size]) * window // size
    share[: least - 1] = 0
    best = np.maximum.accumulate(share)
    at = np.searchsorted(best, np.arange(1, window + 1))
    return np.where(at < len(flags), at + 1, 0)


def hazards(rows: DataFrame, n: int, window: int, n_streams: int, length: int, block: int, least: int, seed: int, kind: int) -> DataFrame:
    """(j, trips, exposure) over all streams: requests are exposed until the first trip."""

    def trips(stream: pd.DataFrame) -> pd.DataFrame:
        at = first_trips(stream.sort_values("step")["deferred"].to_numpy(np.int8), window, least)
        return pd.DataFrame({"j": np.arange(1, window + 1), "trips": (at > 0).astype(np.int64), "exposure": np.where(at > 0, at, length)})

    drawn = blocks(rows.sparkSession, n, n_streams, length, block, seed, kind).join(rows.select("place", F.col("deferred").cast("byte").alias("deferred")), "place")
    each = drawn.select("stream", "step", "deferred").groupBy("stream").applyInPandas(trips, "j long, trips long, exposure long")
    return each.groupBy("j").agg(F.sum("trips").alias("trips"), F.sum("exposure").alias("exposure"))


def calibrate(rows: DataFrame, window: int, target: float, n_streams: int = 200, length: int | None = None, block: int = 20, least: int | None = None, seed: int = 0) -> dict:
    """The least share j/window with at most `target` false trips in 1000 requests, measured again on fresh streams."""
    n = rows.count()
    if not n:
        raise ValueError("no labelled rows")
    length, least = length or max(2000, 20 * window), least or window
    measure = lambda kind: {r["j"]: r for r in hazards(rows, n, window, n_streams, length, block, least, seed, kind).collect()}  # noqa: E731  (`window` rows)
    rate = lambda r: 1000.0 * r["trips"] / r["exposure"]
    fitted = measure(0)
    j = next((j for j in range(1, window + 1) if rate(fitted[j]) <= target), None)
    if j is None:
        raise ValueError(f"no share meets {target} false trips in 1000")
    return {"tau_num": j, "tau_den": window, "rate": rate(fitted[j]), "validation_rate": rate(measure(1)[j]), "n_rows": n}


REPORT = "seed long, tripped_at long, detector string, false_alarm boolean, latency long, wrong_before long, wrong_during long, blocked long, audited long"


def burst(normal: DataFrame, odd: DataFrame, limits: Limits, n_seeds: int, n_before: int, n_burst: int, audit_rate: float = 0.1, seed: int = 7) -> DataFrame:
    """One report for each seed. normal, odd: rows to draw, numbered from 0; the burst starts after n_before requests.

    wrong_*: wrong answers of the student before the burst and in it until the trip; blocked: those that the trip kept from users.
    """
    n, m = normal.count(), odd.count()
    if not n or not m:
        raise ValueError("no rows to draw")
    asked = steps(normal.sparkSession, n_seeds, n_before + n_burst).withColumns(
        {"place": F.when(F.col("step") < n_before, draw(n, seed, 0, F.col("stream"), F.col("step"))).otherwise(draw(m, seed, 1, F.col("stream"), F.col("step"))), "audit": draw(1 << 30, seed, 2, F.col("stream"), F.col("step")) < int(audit_rate * (1 << 30))}
    )
    kinds = normal.select("place", "deferred", "correct", F.lit(False).alias("late")).unionByName(odd.select("place", "deferred", "correct", F.lit(True).alias("late")))
    drawn = asked.withColumn("late", F.col("step") >= n_before).join(kinds, ["place", "late"]).select("stream", "step", F.col("deferred").cast("boolean").alias("deferred"), F.col("correct").cast("boolean").alias("correct"), "audit")

    def report(key: tuple, stream: pd.DataFrame) -> pd.DataFrame:
        rows = stream.sort_values("step")
        machine, at, fired, audited = Machine(limits), None, None, 0
        for i, (deferred, correct, audit) in enumerate(zip(rows["deferred"], rows["correct"], rows["audit"], strict=True)):
            checked = bool(audit) and not deferred
            audited += checked
            if tripped := machine.observe(bool(deferred), (not correct) if checked else None):
                at, fired = i, tripped[0]
                break
        wrong = (~rows["deferred"] & ~rows["correct"]).to_numpy()
        stop = len(rows) if at is None else at + 1
        early = at is not None and at < n_before
        row = (key[0], at, fired, early, None if at is None or early else at - n_before + 1, int(wrong[: min(stop, n_before)].sum()), int(wrong[n_before:stop].sum()), int(wrong[stop:].sum()), audited)
        return pd.DataFrame([row], columns=[c.split()[0] for c in REPORT.split(", ")]).astype({"tripped_at": "Int64", "latency": "Int64"})

    return drawn.groupBy("stream").applyInPandas(report, REPORT)


def verdict(report: DataFrame, max_latency: int, max_false: float) -> DataFrame:
    """One row: every burst was caught, in time at the median, with few false alarms."""
    row = report.agg(F.count("*").alias("n"), F.count("tripped_at").alias("caught"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY latency)").alias("median_latency"), F.avg(F.col("false_alarm").cast("double")).alias("false_rate"))
    return row.withColumn("passes", (F.col("caught") == F.col("n")) & F.coalesce(F.col("median_latency") <= max_latency, F.lit(False)) & (F.col("false_rate") <= max_false))


def sweep(reports: dict[str, DataFrame]) -> DataFrame:
    """(cell, n, caught, p50, p95, max, false_alarms) of the reports of several settings."""
    out = None
    for cell, report in reports.items():
        quantile = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY latency)")
        row = report.agg(F.lit(cell).alias("cell"), F.count("*").alias("n"), F.count("tripped_at").alias("caught"), quantile(0.5).alias("p50"), quantile(0.95).alias("p95"), F.max("latency").alias("max"), F.count_if("false_alarm").alias("false_alarms"))
        out = row if out is None else out.unionByName(row)
    return out


def routes(rows: DataFrame, threshold: float) -> DataFrame:
    """rows(served_by, score, ...) with `route`: the recorded one, else by the score; a row with neither is an error."""
    by_score = F.when(F.col("score") >= threshold, "student").when(F.col("score") < threshold, "teacher")
    return rows.withColumn("route", F.coalesce("served_by", by_score, F.raise_error(F.lit("a row has neither a route nor a score")).cast("string")))


def with_tau(limits: Limits, found: dict) -> Limits:
    return replace(limits, tau_num=found["tau_num"], tau_den=found["tau_den"])
