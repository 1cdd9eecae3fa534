"""Scoring of model answers: SQL is extracted in Spark, each distinct query runs once, verdicts are a table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.text import extract_sql
from lodestar.operators import compare, sqltext
from lodestar.operators.database import Batches, Database
from lodestar.storage import written

VERDICTS = "sql string, gold string, correct boolean, reason string, miss string"


def score(db: Database, answers: DataFrame, tasks: DataFrame, block: int = 1000) -> DataFrame:
    """answers(setup, task_id, output), tasks(task_id, family, gold_sql): (setup, task_id, family, sql, correct, reason, miss).

    Distinct pairs of query and gold query come to the driver a block at a time and run in chunks; verdicts are written and joined back.
    An answer without SQL is wrong with the reason `unparseable`; an answer to an unknown task is left out.
    """
    spark = db.spark
    asked = answers.withColumn("sql", extract_sql(F.col("output"))).join(tasks.select("task_id", "family", F.col("gold_sql").alias("gold")), "task_id")
    pairs = asked.where("sql IS NOT NULL").select("sql", "gold").distinct()
    parts, held, batches = [], [], Batches(db)

    def judged(rows: list) -> DataFrame:
        done = batches.run([r["sql"] for r in rows] + [r["gold"] for r in rows])
        got, gold = done[: len(rows)], done[len(rows) :]
        out = []
        for r, a, b in zip(rows, got, gold, strict=True):
            right, reason = compare.verdict(a, b, sqltext.is_ordered(r["gold"]))
            miss = None if right else compare.classify_miss(a, b) if a.ok and b.ok else a.status if b.ok else "gold_error"
            out.append((r["sql"], r["gold"], right, reason, miss))
        return written(spark.createDataFrame(out, VERDICTS), "verdicts")

    for r in pairs.toLocalIterator():
        held.append(r)
        if len(held) == block:
            parts.append(judged(held))
            held = []
    found = judged(held)
    for part in parts:
        found = found.unionByName(part)
    scored = asked.join(found, ["sql", "gold"], "left")
    none = F.col("sql").isNull()
    return scored.select(
        "setup", "task_id", "family", "sql", F.coalesce("correct", F.lit(False)).alias("correct"), F.when(none, "unparseable").otherwise(F.col("reason")).alias("reason"), F.when(none, "unparseable").otherwise(F.col("miss")).alias("miss"),
    )


def accuracy(scored: DataFrame, *by: str) -> DataFrame:
    """n, correct, unparseable and accuracy, by setup and the given columns."""
    counts = scored.groupBy("setup", *by).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if(F.col("reason") == "unparseable").alias("unparseable"))
    return counts.withColumn("accuracy", F.col("correct") / F.col("n"))


def misses(scored: DataFrame) -> DataFrame:
    """Wrong answers by setup and kind of miss."""
    return scored.where("NOT correct").groupBy("setup").pivot("miss").agg(F.count(F.lit(1))).na.fill(0)


def first_gold(runs: DataFrame, seed: int) -> DataFrame:
    """(question, gold_sql) of completed runs of a seed: of runs(run_id, seed, status, question, gold_sql) the first run that has the question."""
    mine = runs.where((F.col("seed") == seed) & (F.col("status") == "completed"))
    return mine.groupBy("question").agg(F.min_by("gold_sql", "run_id").alias("gold_sql"))


def with_tasks(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """rows(question, ...) with the task_id and family of the task with that question; `row` and `unknown` where there is none."""
    named = tasks.groupBy("question").agg(F.min(F.struct("task_id", "family")).alias("t"))
    return rows.join(named, "question", "left").select(*rows.columns, F.coalesce("t.task_id", F.lit("row")).alias("task_id"), F.coalesce("t.family", F.lit("unknown")).alias("family"))


def question_of(messages: Column, marker: str) -> Column:
    """The question in the last user message of a chat: what follows the last marker, or the whole message."""
    last = F.element_at(F.filter(messages, lambda m: m["role"] == "user"), -1)["content"]
    return F.trim(F.element_at(F.split(last, f"\\Q{marker}\\E"), -1))


def same_prompt(train: Column, evaluation: Column) -> Column:
    """Whether the messages of a training row begin with those of the evaluation prompt, to the byte."""
    return F.slice(train, 1, F.size(evaluation)) == evaluation


def better_arm(arms: DataFrame, base_high: float) -> DataFrame:
    """Of arms(arm, correct, low, rate) whose lower limit is above the base's upper one: most correct, then the lower rate; no row if there is none."""
    return arms.where(F.col("low") > base_high).orderBy(F.desc("correct"), "rate", "arm").limit(1)


def balanced_draws(rows: DataFrame, sizes: Sequence[int], seed: int) -> DataFrame:
    """rows(task_id, family) of disjoint draws of the given sizes, `draw` being their number: families take turns, in hashed order.

    Only the rows that could be drawn are put in order: of each family its first sum(sizes).
    """
    h = F.sha2(F.concat_ws("|", F.lit(seed), "family", "task_id"), 256)
    turn = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("family").orderBy(h, "task_id"))).where(F.col("_turn") <= sum(sizes))
    picked = turn.orderBy("_turn", F.sha2(F.concat_ws("|", F.lit(seed), "family"), 256)).limit(sum(sizes))
    placed = picked.withColumn("_place", F.row_number().over(Window.orderBy("_turn", F.sha2(F.concat_ws("|", F.lit(seed), "family"), 256))))  # as many as are drawn
    draw, edge = F.lit(None).cast("int"), 0
    for k, size in enumerate(sizes):
        draw = F.when((F.col("_place") > edge) & (F.col("_place") <= edge + size), k).otherwise(draw)
        edge += size
    return placed.withColumn("draw", draw).select(*rows.columns, "draw")


def may_score(done: DataFrame, name: str, needed: Sequence[str]) -> str | None:
    """Why a one-shot scoring may not run, of done(stage, status): it ran already, or a stage that it needs isn't complete."""
    have = {r["stage"] for r in done.where(F.col("status") == "complete").select("stage").where(F.col("stage").isin(name, *needed)).distinct().collect()}
    return "already scored" if name in have else next((f"missing {n}" for n in needed if n not in have), None)


def target_families(asked: Sequence[str], allowed: Sequence[str], held_out: Sequence[str]) -> list[str]:
    """Distinct families that may be generated for, sorted."""
    return sorted(set(asked) & set(allowed) - set(held_out))


def claims(both: int, only_a: int, only_b: int, neither: int, low: float) -> dict[str, bool]:
    """What may be claimed of a against b: `better` where the lower limit of the ratio is above 1, `more_right` on these items; exact fractions."""
    n = both + only_a + only_b + neither
    return {"better": low > 1.0, "more_right": Fraction(both + only_a, max(n, 1)) > Fraction(both + only_b, max(n, 1))}


def gate_power(spark: SparkSession, n: int, rates: tuple[float, float, float], sims: int = 400, least_ratio: float = 0.85, level: float = 0.05, seed: int = 0) -> DataFrame:
    """(promoted, sims): how often a gate of n items promotes, if each item is right for both, a alone or b alone at the given rates. A simulation is a row."""
    from lodestar.functions import stats

    def run(batches):  # noqa: ANN001, ANN202
        import numpy as np

        for batch in batches:
            yes = 0
            for i in batch["id"]:
                cells = np.random.default_rng([seed, int(i)]).multinomial(n, [*rates, max(0.0, 1 - math.fsum(rates))])
                yes += stats.promote(*map(int, cells), least_ratio=least_ratio, level=level)
            yield pd.DataFrame({"promoted": [yes], "sims": [len(batch)]})

    return spark.range(sims).mapInPandas(run, "promoted long, sims long").agg(F.sum("promoted").alias("promoted"), F.sum("sims").alias("sims"))
