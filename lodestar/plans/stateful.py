"""Queries that SQL cannot express: state machines, iterated fits, certificates."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import ranks, stats
from lodestar.functions import text as texts
from lodestar.operators import replay, routing
from lodestar.plans import toolcalls
from lodestar.plans.analytics import oracle, run_sql
from lodestar.storage import written
from lodestar.streaming import drift, limits, simulate


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def drift_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    audit = F.when(F.col("event_type") == "purchase", F.col("value") > 12)
    events = _events(spark, sf_dir).select(F.col("user_id").alias("stream"), F.col("event_id").alias("request_id"), (F.col("event_type") == "error").alias("deferred"), audit.alias("audit"))
    return drift.replay(events, drift.Limits(tau_num=4, least=10, audits=10, fail=6))


def router_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("event_id", "value", (F.col("user_id") % 10).cast("double").alias("user_bucket"), (F.col("event_type") != "error").cast("int").alias("correct"))
    means, stds, weights = routing.fit(rows, ["value", "user_bucket"], "correct")
    scored = routing.decide(rows, routing.logit(["value", "user_bucket"], means, stds, weights), 0.8)
    return scored.select("event_id", F.round("score", 6).alias("score"), "served_by")


def risk_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds come from the FIT half of the requests alone, so that the other half certifies thresholds that it didn't choose."""
    rows = _events(spark, sf_dir).select("event_id", "value", (F.col("event_type") == "error").alias("wrong"))
    grid = ranks.coverage_grid(rows.where("event_id % 2 = 0"), "value", [i / 20 for i in range(1, 21)])
    held = rows.where("event_id % 2 = 1")
    counts = held.agg(*[c for i, t in enumerate(grid) for c in (F.count_if(F.col("value") >= t).alias(f"n{i}"), F.count_if((F.col("value") >= t) & F.col("wrong")).alias(f"e{i}"))]).first() if grid else None
    curve = [(t, counts[f"n{i}"], counts[f"e{i}"]) for i, t in enumerate(grid)]
    return spark.createDataFrame([(alpha, stats.certify(curve, alpha, 0.05)) for alpha in (0.15, 0.25, 0.35)], "alpha double, threshold double")


def rate_limit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests of a user in six hours, five a day."""
    requests = _events(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return limits.decide(requests, 3, 6 * 3_600_000_000, 5)


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, deferred, correct) of the labels, numbered by doc_id."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return ranks.numbered(rows.select("doc_id", (F.col("quality") == 0).alias("deferred"), (F.col("toxic") == 0).alias("correct")), "doc_id")


def calibrated_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simulate.calibrate(_flags(spark, sf_dir), 20, 0.5)
    return spark.createDataFrame([tuple(found.values())], "tau_num int, tau_den int, rate double, validation_rate double, n_rows int")


def burst_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and those of them that the teacher gets or that are wrong (all, where there are none), numbered."""
    rows = _flags(spark, sf_dir)
    odd = ranks.numbered(rows.where("deferred OR NOT correct").drop("place"), "doc_id")
    return rows, rows if odd.isEmpty() else odd


def burst_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The burst draws from rows that the teacher gets, or that are wrong."""
    return simulate.burst(*burst_rows(spark, sf_dir), drift.Limits(tau_num=6), 300, 300, 200)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state tables as (kind, id, fields)."""
    parts = {
        "account": (toolcalls.FREE, "CAST(account_id AS STRING)", ("plan", "seats", "status", "taken")),
        "user": (toolcalls.USERS, "email", ("account_id", "role")),
        "invoice": (toolcalls.INV, "CAST(invoice_id AS STRING)", ("status", "amount_cents")),
        "ticket": (toolcalls.TIX, "CAST(ticket_id AS STRING)", ("status", "assignee")),
    }
    out = None
    for kind, (source, key, fields) in parts.items():
        rows = run_sql(spark, sf_dir, f"SELECT {key} AS id, {', '.join(fields)} FROM {source} s")
        part = rows.select(F.lit(kind).alias("kind"), "id", F.to_json(F.struct(*fields)).alias("fields"))
        out = part if out is None else out.unionByName(part)
    return out


def _call(text: Column) -> Column:
    """A call as `toolcalls.call` writes it; no value in it has quotes."""
    return F.struct(F.substring_index(F.substr(text, F.lit(9)), ',"tool":"', 1).alias("args"), F.substring_index(F.substring_index(text, '"tool":"', -1), '"', 1).alias("tool"))


def task_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(template, task) of all templates, once each; no calls are written for it."""
    return run_sql(spark, sf_dir, " UNION ALL ".join(f"SELECT '{name}' AS template, xxhash64('{name}', task_key) AS task FROM ({sql}) t" for name, sql in toolcalls.T.items())).distinct()


def task_calls(spark: SparkSession, sf_dir: str, some: DataFrame | None = None) -> DataFrame:
    """(task, template, step, tool, args, last) of all templates, last being the task's last step. task is a hash of template and key; the rows of a bulk template's group are its steps,
    in order of their text. A task without calls has one row, of step -1 without tool.

    Templates are put together before their calls are read, so that one plan step does it for all. `some` (task), which goes to all tasks, are the only ones wanted.
    """
    one = lambda name, column: f"SELECT xxhash64('{name}', task_key) AS task, '{name}' AS template, {column} FROM ({toolcalls.T[name]}) t"

    def every(names: list[str], column: str) -> DataFrame:
        rows = run_sql(spark, sf_dir, " UNION ALL ".join(one(n, column) for n in names))
        return rows if some is None else rows.join(F.broadcast(some), "task", "left_semi")

    bulk = [n for n, sql in toolcalls.T.items() if " AS call FROM " in sql]
    listed = every([n for n in toolcalls.T if n not in bulk], "calls").select("task", "template", F.coalesce(F.when(F.col("calls") != "[]", F.split(F.expr("substring(calls, 2, length(calls) - 2)"), r',(?=\{"args":)')), F.array().cast("array<string>")).alias("all"))
    listed = listed.select("task", "template", (F.size("all") - 1).cast("long").alias("last"), F.posexplode_outer("all").alias("step", "text"))
    single = every(bulk, "call").select("task", "template", (F.count("*").over(Window.partitionBy("task")) - 1).alias("last"), (F.row_number().over(Window.partitionBy("task").orderBy("call")) - 1).alias("step"), F.col("call").alias("text"))
    return listed.unionByName(single).withColumn("c", _call(F.col("text"))).select("task", "template", F.coalesce(F.col("step").cast("long"), F.lit(-1).cast("long")).alias("step"), "c.tool", "c.args", "last")


def replay_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without calls run through and change nothing."""
    return replay.replay(task_calls(spark, sf_dir), entities(spark, sf_dir))


def replay_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of fault, how many wrong answers the comparison of states tells from the right one, and how many leave the state as it was.

    The state is written once, so that its plan isn't part of those that read it, as calls are by `told_faults`; right and wrong answers are replayed in one pass.
    """
    return replay.told_faults(task_calls(spark, sf_dir).where("step >= 0"), written(entities(spark, sf_dir), "state"))


def extracted_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL in answers of the assistant, and the skeleton of each question; texts without SQL give null."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", texts.extract_sql(F.col("text")).alias("sql"), F.sha2(texts.skeleton(F.col("text")), 256).alias("skeleton_sha256"))


def extracted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of calls in answers: each task's calls as a model might write them, fenced or not, found again. `same`: as they were."""
    rows = run_sql(spark, sf_dir, toolcalls.T["dc_onboard"]).unionByName(run_sql(spark, sf_dir, toolcalls.T["eg_suspend"]))
    n = F.pmod(F.xxhash64("task_key"), F.lit(3))
    output = F.when(n == 0, F.concat(F.lit("<think>[1]</think>Sure:\n```json\n"), "calls", F.lit("\n```\nDone."))).when(n == 1, F.concat(F.lit("```\n"), "calls")).otherwise(F.concat(F.lit("```json\n[]\n```\n```json\n"), "calls", F.lit("\n```")))
    return rows.select("task_key", replay.extracted_calls(output).alias("found"), F.col("calls")).withColumn("same", F.col("found") == F.col("calls")).drop("calls")


def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of each share, by narrowing intervals."""
    rows, levels = _events(spark, sf_dir).where("event_type = 'view'"), (0.1, 0.5, 0.9)
    n = rows.where("value IS NOT NULL").count()
    found = ranks.largest(rows, "value", [max(1, ceil(x * n - 1e-9)) for x in levels])
    return spark.createDataFrame([(x, t) for x, t in zip(levels, found, strict=True) if t is not None], "level double, threshold double")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (drift_replay, router_scores, risk_certificate, rate_limit_decisions, calibrated_tau, burst_replay, replay_final_state, replay_faults, extracted_sql, extracted_calls, coverage_grid)}


#: The defined results, by SQL.
ORACLE = {
    "coverage_grid": "WITH r AS (SELECT value, row_number() OVER (ORDER BY value DESC) AS k, count(*) OVER () AS m FROM {events} WHERE event_type = 'view' AND value IS NOT NULL) SELECT CAST(level AS DOUBLE) AS level, value AS threshold FROM r JOIN (SELECT 0.1 AS level UNION ALL SELECT 0.5 UNION ALL SELECT 0.9) g ON k = greatest(1, ceil(level * m - 1e-9))",
    "extracted_calls": f"SELECT task_key, calls AS found, true AS same FROM ({toolcalls.T['dc_onboard']} UNION ALL {toolcalls.T['eg_suspend']}) t",
}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for name, sql in ORACLE.items()}
